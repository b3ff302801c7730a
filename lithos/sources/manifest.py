"""Manifests of backup copies as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "version string, copy_uuid string, copy_type string, format string, source string, target string, created_at string, base_copy string,"
    " aggregation struct<layout:string,max_blob_size:long,file_threshold:long,shard_count:int>,"
    " subtasks array<struct<id:string,control_file:string,log_file:string,succeeded:boolean>>"
)
#: What a manifest without these settings means.
DEFAULTS = {"layout": "shard", "max_blob_size": 64 << 20, "file_threshold": 1 << 20, "shard_count": 16}


def write_manifest(subtasks: DataFrame, key: str, version: str = "1.0", fmt: str = "common") -> DataFrame:
    """One JSON manifest per key, from rows (key, id, succeeded); settings without a value are left out."""
    listed = subtasks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "succeeded"))).alias("subtasks"))
    return listed.select(key, F.to_json(F.struct(F.lit(version).alias("version"), F.lit(fmt).alias("format"), "subtasks")).alias("json"))


def read_manifest(rows: DataFrame, column: str) -> DataFrame:
    """rows with a struct m of SCHEMA parsed from a JSON column; an absent aggregation takes DEFAULTS."""
    out = rows.withColumn("m", F.from_json(column, SCHEMA))
    plain = F.struct(*[F.lit(v).cast("string" if isinstance(v, str) else "int" if k == "shard_count" else "long").alias(k) for k, v in DEFAULTS.items()])
    return out.withColumn("m", F.col("m").withField("aggregation", F.coalesce("m.aggregation", plain))).drop(column)
