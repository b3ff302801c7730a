"""Helpers that the operators share: column picking, shared tables, batch bounds."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.session import release, scratch, ship_package, spread

__all__ = ["BATCH_ROWS", "bounded", "discard", "made", "materialize", "numbered", "place", "project", "release", "spread", "sweep", "u64_hex"]

#: The tables that materialize() has made and sweep() has not deleted.
_MADE: list[str] = []
#: Rows in one Arrow batch handed to a Python worker; bounds a worker's memory.
BATCH_ROWS = 512


def project(df: DataFrame, **want: str) -> DataFrame:
    """Pick the named columns by exact name and cast each to the given type.

    Other columns may carry any name, also one that differs from a wanted name
    only by case or repeats it; the first exact match counts. A wanted column
    that is absent is a ValueError.
    """
    names = df.columns
    missing = [n for n in want if n not in names]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    if len({n.lower() for n in names}) == len(names):
        return df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in want.items()])
    flat = df.toDF(*[f"__c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"__c{names.index(n)}").cast(t).alias(n) for n, t in want.items()])


def numbered(df: DataFrame) -> DataFrame:
    """df with columns named by place, __c0 and so on, so that no name clashes; toDF(*df.columns) undoes it."""
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The name that numbered() gives to the first column of exactly that name."""
    return f"__c{df.columns.index(name)}"


def bounded(spark: SparkSession) -> SparkSession:
    """Ready a session for Python workers: ship the package, and keep Arrow batches so small that their whole texts fit."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, outlives executors."""
    path = scratch(df.sparkSession, name)
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """A mark for sweep()."""
    return len(_MADE)


def sweep(mark: int, keep: DataFrame) -> None:
    """Delete the tables made by materialize() since a mark, but for the last one, which is keep."""
    for path in _MADE[mark:-1]:
        _delete(keep.sparkSession, path)
    del _MADE[mark:-1]


def _delete(spark: SparkSession, path: str) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by materialize()."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def u64_hex(col: Column) -> Column:
    """A 64-bit integer as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
