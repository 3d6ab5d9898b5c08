"""Run directories, knowledge folders and report sinks."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.documents import first_json

#: Files that a run directory must have.
RUN_FILES = {"manifest": "manifest.json", "request": "request.json", "system_prompt": "prompts/system_prompt.txt", "user_prompt": "prompts/user_prompt.txt", "expected_schema": "schemas/expected_model_output.schema.json"}


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five files of a run as text (``raw``), and ``images``: name, path and view of those of user messages.

    The directory and its files are looked for at once: a missing one raises
    FileNotFoundError. Images whose file is missing are left out.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"run dir not found: {path}")
    for rel in RUN_FILES.values():
        if not _exists(spark, f"{path}/{rel}"):
            raise FileNotFoundError(f"missing required file in run dir: {rel}")
    out = {name: spark.read.text(f"{path}/{rel}", wholetext=True).select(F.col("value").alias("raw")) for name, rel in RUN_FILES.items()}
    kind = "struct<messages:array<struct<role:string,content:array<struct<type:string,path:string,name:string,physical_view:string>>>>>"
    parts = out["request"].select(F.explode(F.from_json("raw", kind)["messages"]).alias("m")).where("m.role = 'user'").select(F.posexplode("m.content").alias("pos", "c")).where("c.type = 'image' AND c.path <> ''")
    stem = F.regexp_extract("c.path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    listed = parts.select("pos", F.coalesce("c.name", stem).alias("name"), "c.path", F.coalesce("c.physical_view", F.lit("unknown")).alias("physical_view"))
    there = [r["path"] for r in listed.select("path").distinct().collect() if _exists(spark, f"{path}/{r['path']}")]  # a run has a handful
    out["images"] = listed.where(F.col("path").isin(there)).drop("pos")
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, height, width, gray`` of image files: brightness row by row, 0 to 1; unreadable files are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches):
        for b in batches:
            out = []
            for data, h, w, n in zip(b["data"], b["height"], b["width"], b["nChannels"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(float)
                gray = x[:, :, 0] if n == 1 else x[:, :, 2] * 0.299 + x[:, :, 1] * 0.587 + x[:, :, 0] * 0.114
                out.append((gray / 255).ravel())
            yield pd.DataFrame({"path": b["origin"], "height": b["height"], "width": b["width"], "gray": out})

    return raw.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "path string, height int, width int, gray array<double>")


def image_sections(images: DataFrame) -> DataFrame:
    """Images as sections ``path, il, trace, s, amp``: columns are traces, rows samples."""
    each = images.select("path", "width", F.posexplode("gray").alias("k", "amp"))
    return each.select("path", F.xxhash64("path").alias("il"), (F.col("k") % F.col("width")).alias("trace"), F.floor(F.col("k") / F.col("width")).cast("int").alias("s"), "amp")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``path, il, trace, samples`` of .npy arrays: (il, trace, sample), or one section of (sample, trace).

    Files that are no arrays of two or three axes are left out.
    """

    def run(batches):
        for b in batches:
            for where, data in zip(b["path"], b["content"], strict=True):
                try:
                    x = np.load(io.BytesIO(data), allow_pickle=False).astype(float)
                except (ValueError, EOFError, TypeError):
                    continue
                if x.ndim == 2:
                    x = x.T[None]
                if x.ndim != 3:
                    continue
                il, xl = np.divmod(np.arange(x.shape[0] * x.shape[1]), max(x.shape[1], 1))
                yield pd.DataFrame({"path": where, "il": il.astype(np.int32), "trace": xl.astype(np.int32), "samples": list(x.reshape(-1, x.shape[2]))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, il int, trace int, samples array<double>")


def as_volume(traces: DataFrame) -> DataFrame:
    """Traces with an ``il``: a lone section is the inline 0."""
    return traces if "il" in traces.columns else traces.withColumn("il", F.lit(0))


def inline_slice(traces: DataFrame, place: int) -> DataFrame:
    """``xl, samples`` of the inline at a place (not number) of its axis."""
    return _at_place(traces, "il", place).drop("il")


def crossline_slice(traces: DataFrame, place: int) -> DataFrame:
    """``il, samples`` of the crossline at a place of its axis."""
    return _at_place(traces, "xl", place).drop("xl")


def time_slice(traces: DataFrame, sample: int) -> DataFrame:
    """``il, xl, amp`` at a sample of every trace."""
    return traces.select("il", "xl", F.get("samples", F.lit(sample)).alias("amp"))


def _at_place(traces: DataFrame, axis: str, place: int) -> DataFrame:
    # an axis has some thousand numbers at most; they are ordered in one task
    numbers = traces.select(axis).distinct().withColumn("_n", F.row_number().over(Window.orderBy(axis)) - 1)
    return traces.join(F.broadcast(numbers.where(F.col("_n") == place).drop("_n")), axis)


def load_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of a folder's markdown files; the id is the file's stem."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("doc_id"), F.col("value").alias("text"))


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines of a report."""
    df.write.mode("overwrite").json(path)


def write_plan(spark: SparkSession, raw: str, path: str) -> None:
    """A plan's JSON under ``vlm_plan``, or what could not be read as one under ``vlm_plan_failed``."""
    ok = first_json(raw)
    spark.range(1).select(F.lit(ok or raw).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{'vlm_plan' if ok else 'vlm_plan_failed'}")


def write_volume(painted: DataFrame, path: str, axis: str = "inline") -> None:
    """A sparse attribute volume, partitioned by class; only stacked inlines are written."""
    if axis != "inline":
        raise NotImplementedError(f"volumes are written along inlines, not along {axis}")
    painted.write.mode("overwrite").partitionBy("class_id" if "class_id" in painted.columns else "class_name").parquet(path)


def synthetic_volume(spark: SparkSession, inlines: int = 30, crosslines: int = 60, samples: int = 200, seed: int = 7) -> DataFrame:
    """A trace table of noise with three plane reflections, and a dark box where the volume is large enough."""
    rows = spark.range(inlines * crosslines).select((F.col("id") / crosslines).cast("int").alias("il"), (F.col("id") % crosslines).cast("int").alias("xl"))
    planes = F.array(*[F.lit(int(samples * f)) for f in (0.25, 0.45, 0.7)])
    amp = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.when(F.array_contains(planes, s), 1.2).otherwise(0.0))
    noisy = rows.select("il", "xl", F.posexplode(amp).alias("s", "a"))
    box = F.lit(inlines > 15 and crosslines > 35 and samples > 65) & F.col("il").between(10, 14) & F.col("xl").between(25, 34) & F.col("s").between(60, 64)
    amped = noisy.withColumn("amp", F.col("a") + F.randn(seed) * 0.05 - F.when(box, 2.0).otherwise(0.0))
    return amped.groupBy("il", "xl").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "amp"))), lambda x: x["amp"]).alias("samples"))


def slices(traces: DataFrame, every: int = 1) -> DataFrame:
    """Every ``every``-th inline."""
    return traces.where(F.pmod("il", F.lit(every)) == 0)


def volume_metadata(traces: DataFrame, interval_ms: float = 4.0) -> DataFrame:
    """One row: axis limits, numbers of traces and samples, length in time."""
    return traces.agg(F.min("il").alias("il_min"), F.max("il").alias("il_max"), F.count("*").alias("n_traces"), F.max(F.size("samples")).alias("n_samples")).withColumn("length_ms", F.col("n_samples") * F.lit(interval_ms))


def nearest(values: DataFrame, targets: DataFrame, key: str, at: str, target: str) -> DataFrame:
    """The value of each key nearest to each target, the smaller of equals.

    Values and targets are sorted together by key; the nearest value is the last
    before a target or the first after it, so no target meets other values.
    """
    both = values.select(key, F.col(at).alias("_v"), F.lit(None).cast("double").alias("_t")).unionByName(targets.select(key, F.col(target).cast("double").alias("_v"), F.col(target).cast("double").alias("_t")))
    w = Window.partitionBy(key).orderBy("_v", F.col("_t").isNotNull())
    own = F.when(F.col("_t").isNull(), F.col("_v"))
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_b", before).withColumn("_a", after).where("_t IS NOT NULL")
    best = F.when(F.col("_b").isNull() | (F.col("_a") - F.col("_t") < F.col("_t") - F.col("_b")), F.col("_a")).otherwise(F.col("_b"))
    return near.select(key, F.col("_t").alias(target), best.alias("nearest")).where("nearest IS NOT NULL").distinct()


def latest_round(rows: DataFrame, step: str = "step", round_: str = "round") -> DataFrame:
    """Rows of the last round of each step."""
    last = F.max(round_).over(Window.partitionBy(step))
    return rows.withColumn("_last", last).where(F.col(round_) == F.col("_last")).drop("_last")
