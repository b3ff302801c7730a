"""What operators need of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes a core under which a table is dealt over all cores before costly work on its rows.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small: a table of one file with one row group is else one task, however many cores there are.

    A table above SPREAD_BYTES a core has partitions enough, so what goes through the shuffle is bounded.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SPREAD_BYTES else df


def ship_package(spark: SparkSession) -> None:
    """Give the package to Python workers, which need not share the driver's module path; once per context."""
    context = spark.sparkContext
    if getattr(context, "_lithos_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lithos-"), "lithos.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(archive)
    context._lithos_shipped = True


def release(spark: SparkSession) -> None:
    """Let the driver give back what the plans of finished jobs have left: its heap else grows to its bound and stays there."""
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, an own one if all run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lithos-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
