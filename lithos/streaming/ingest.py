"""Continuous catalog ingest and event-time windows.

The incremental state of a catalog is a table of the last row per key. A stream of
file rows is folded into it batch by batch (foreachBatch), each batch first reduced
to its own last rows; a batch that is run again writes the same rows under its
number, so the sink is idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **limits: str) -> DataFrame:
    """A stream of files; limits are maxFilesPerTrigger, maxBytesPerTrigger and the like (back-pressure)."""
    reader = spark.readStream.schema(schema).format(fmt)
    for name, value in limits.items():
        reader = reader.option(name, value)
    return reader.load(path)


def _last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def fold_last(stream: DataFrame, keys: list[str], order: str, state: str, checkpoint: str) -> None:
    """Run the stream until no input is left; each batch leaves its last rows under state/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        _last_rows(batch, keys, [order]).write.mode("overwrite").parquet(f"{state}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_state(spark: SparkSession, state: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key over all batches; of equal orders the later batch wins."""
    return _last_rows(spark.read.parquet(state), keys, [order, "batch"]).drop("batch")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> dict:
    """Run a stream over what is there and return its last progress."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.lastProgress


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates per window and keys; on a stream give events a watermark first."""
    out = events.groupBy(F.window(ts, width).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def sliding(events: DataFrame, ts: str, width: str, step: str, *keys: str, aggregates: dict[str, Column]) -> DataFrame:
    out = events.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def sessions(events: DataFrame, ts: str, gap: str, *keys: str, aggregates: dict[str, Column]) -> DataFrame:
    out = events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("session_start"), *keys, *aggregates)
