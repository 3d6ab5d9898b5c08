"""Session settings that the operators are written for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``more`` are further settings."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | more
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    builder = SparkSession.builder.appName("quarry").config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless they find it by path.

    Workers inherit the working folder and PYTHONPATH; where neither holds the
    package, Arrow functions could not be loaded there.
    """
    paths = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if str(ROOT) in paths or getattr(spark.sparkContext, "_quarry_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in [*ROOT.glob("quarry/**/*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._quarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a temporary folder stands in, which is only right where driver
    and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here, so a lost executor costs a re-read."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
