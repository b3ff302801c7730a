"""Which pipeline serves a pair of source and target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dispatch(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Every kind of source with every kind of target (three each): pipeline, route, and whether a restore takes the source."""
    kinds = targets.agg(F.collect_set("kind").alias("targets"))
    pairs = sources.select(F.col("kind").alias("source"), F.lit(1).alias("k")).distinct().join(kinds.withColumn("k", F.lit(1)), "k")
    rows = pairs.select("source", F.explode("targets").alias("target"))
    local = (F.col("source") == "Local") & (F.col("target") == "Local")
    return rows.select(
        "source", "target", F.when(local, "blocking").otherwise("async").alias("pipeline"),
        F.concat(F.lower("source"), F.lit("_to_"), F.lower("target")).alias("route"), (F.col("source") == "Local").alias("valid_copy_source"),
    )
