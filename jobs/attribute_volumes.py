"""Turns detections and the verdicts on them into attribute volumes, a partition for each class and image.

    spark-submit jobs/attribute_volumes.py --config jobs/attribute_volumes.json [--tables DIR] [--output DIR] [--images 1,2]

Detections that a sure verdict rejects are dropped, of overlapping ones of a class the
more confident stay, and what is left paints the cells it covers with its confidence.
Three outputs lie under ``output``: ``kept`` (the detections that stay, Parquet by
image), ``volumes`` (painted cells, Parquet by class and image) and ``report`` (counts
per image, JSON by image). All are written by dynamic overwrite: a run replaces the
images it works on, whole, and leaves others as they are, so it can be run again, and
for a part of the images with ``images``. A class that an earlier run painted in such an
image, and that has no kept detections now, gets a volume without cells above 0. Images
that are no longer in the tables keep what they had.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.errors import AnalysisException  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quarry.operators import detections as det  # noqa: E402
from quarry.session import session, ship_package, written  # noqa: E402
from quarry.sources import views  # noqa: E402

log = logging.getLogger("attribute_volumes")


def _write(df: DataFrame, kind: str, path: str, *parts: str) -> None:
    out = df.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
    (out.json if kind == "json" else out.parquet)(path)
    log.info("wrote %s", path)


def run(spark: SparkSession, conf: dict) -> dict:
    """Writes all outputs and returns the numbers of detections read, dropped, suppressed and kept, and of cells.

    ``conf``: ``tables`` and ``output`` (paths), ``overlap``, ``least_confidence``,
    ``columns`` and ``rows`` of a volume's slice, ``images`` (numbers, or null for all).
    """
    out, nx, ny = conf["output"], int(conf.get("columns", 20)), int(conf.get("rows", 50))
    found, verdicts = views.detections(spark, conf["tables"]).drop("e6"), views.verifications(spark, conf["tables"])
    if conf.get("images"):
        found, verdicts = (x.where(F.col("image").isin(list(conf["images"]))) for x in (found, verdicts))
    outcomes = det.filter_false_positives(verdicts, found, float(conf.get("least_confidence", 0.5)))
    gone = outcomes.where("outcome = 'dropped'").select(F.col("matched").alias("det_id"), F.lit("rejected").alias("fate"))
    live = det.surviving(found, outcomes)
    best = det.nms_greedy(live, float(conf.get("overlap", 0.3))).select("det_id", F.lit("kept").alias("fate"))
    judged = found.join(gone.unionByName(best), "det_id", "left").withColumn("fate", F.coalesce("fate", F.lit("suppressed")))
    _write(judged, "parquet", f"{out}/kept", "image")
    # from here on from what was written: the steps above are not run again
    judged = spark.read.schema(judged.schema).parquet(f"{out}/kept")
    if conf.get("images"):
        judged = judged.where(F.col("image").isin(list(conf["images"])))
    painted = det.paint_volume(judged.where("fate = 'kept'").withColumn("in_roi", F.lit(True)), nx, ny)
    # a class without kept detections has one cell of confidence 0, which replaces what an earlier run painted
    seen = judged.select("class_id", "image").unionByName(_painted_before(spark, conf, found).join(judged.select("image").distinct(), "image", "left_semi"))
    blank = seen.distinct().join(judged.where("fate = 'kept'").select("class_id", "image"), ["class_id", "image"], "left_anti")
    blank = blank.select("class_id", "image", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0.0).alias("confidence"))
    _write(painted.unionByName(blank), "parquet", f"{out}/volumes", "class_id", "image")
    count = lambda fate: F.count(F.when(F.col("fate") == fate, 1)).alias(fate)
    report = judged.groupBy("image").agg(F.count("*").alias("found"), count("rejected"), count("suppressed"), count("kept"), F.max("confidence").alias("best"))
    _write(report, "json", f"{out}/report", "image")
    totals = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "rejected", "suppressed", "kept")]).first().asDict()
    totals["cells"] = volumes(spark, conf).count()
    log.info("read %(found)d detections: %(rejected)d rejected, %(suppressed)d suppressed, %(kept)d kept", totals)
    log.info("%s holds %d painted cells", out, totals["cells"])
    return totals


def _schema(found: DataFrame) -> str:
    return f"x int, y int, confidence double, class_id {found.schema['class_id'].dataType.simpleString()}, image {found.schema['image'].dataType.simpleString()}"


def _painted_before(spark: SparkSession, conf: dict, found: DataFrame) -> DataFrame:
    """``class_id, image`` of the volumes that are there, apart from the folder that is written next; none on a first run."""
    try:
        there = spark.read.schema(_schema(found)).parquet(f"{conf['output']}/volumes")
    except AnalysisException:
        return spark.createDataFrame([], _schema(found)).select("class_id", "image")
    return written(there.select("class_id", "image").distinct(), "painted-before")


def volumes(spark: SparkSession, conf: dict) -> DataFrame:
    """The painted cells as they are on disk: ``class_id, image, x, y, confidence``."""
    found = views.detections(spark, conf["tables"])
    return spark.read.schema(_schema(found)).parquet(f"{conf['output']}/volumes").where("confidence > 0").select("class_id", "image", "x", "y", "confidence")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", required=True, help="JSON file of settings")
    p.add_argument("--tables", help="in place of the setting tables")
    p.add_argument("--output", help="in place of the setting output")
    p.add_argument("--images", help="numbers of images, with commas between them")
    given = vars(p.parse_args())
    conf = json.loads(Path(given["config"]).read_text()) | {k: v for k, v in given.items() if v and k in ("tables", "output")}
    if given["images"]:
        conf["images"] = [int(x) for x in given["images"].split(",")]
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session()
    try:
        ship_package(spark)
        run(spark, conf)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
