"""Queries over event time and over a stream (event-time windows extend the catalog engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos import catalog
from lithos.queries import query
from lithos.session import scratch
from lithos.streaming import ingest

_CENTS = "round(value * 100)::BIGINT"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    return catalog.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", cents)


@query(f"""
    SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*)::BIGINT AS n, sum({_CENTS})::BIGINT AS cents FROM events GROUP BY 1, 2""")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.tumbling(_events(spark, sf), "ts", "1 day", "event_type", aggregates={"n": F.count(F.lit(1)), "cents": F.sum("cents")})
    return rows.select(catalog.epoch(F.col("window_start")).alias("start"), "event_type", "n", "cents")


@query(f"""
    WITH e AS (SELECT epoch(date_trunc('second', ts))::BIGINT AS t, event_type, {_CENTS} AS cents FROM events)
    SELECT (t // 21600 - k) * 21600 AS start, event_type, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM e, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""")
def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.sliding(_events(spark, sf), "ts", "12 hours", "6 hours", "event_type", aggregates={"n": F.count(F.lit(1)), "cents": F.sum("cents")})
    return rows.select(catalog.epoch(F.col("window_start")).alias("start"), "event_type", "n", "cents")


@query(f"""
    WITH g AS (SELECT user_id, ts, {_CENTS} AS cents, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM s GROUP BY user_id, session""")
def events_session(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.sessions(_events(spark, sf), "ts", "30 minutes", "user_id", aggregates={"n": F.count(F.lit(1)), "cents": F.sum("cents")})
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("session_start"))
    return rows.select("user_id", micros.alias("start_us"), "n", "cents")


@query("""
    SELECT conv_id, arg_max(turn, turn)::BIGINT AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id""")
def incremental_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The state that a stream over conversations leaves: the last turn of each."""
    work = scratch(spark, "stream")
    schema = spark.read.parquet(f"{sf}/conversations.parquet").schema
    # a path that is one file is read through a pattern
    stream = ingest.read_files(spark, f"{sf}/conversations.parque[t]", schema).select("conv_id", "turn", "role")
    ingest.fold_last(stream, ["conv_id"], "turn", f"{work}/state", f"{work}/checkpoint")
    return ingest.read_state(spark, f"{work}/state", ["conv_id"], "turn").select("conv_id", "turn", "role")
