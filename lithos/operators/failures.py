"""Failures and retries: schedules, failure reports, writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.scalars import RetryPolicy

#: Columns of a failure row, in the order in which they are written.
COLUMNS = ("time", "phase", "operation", "item_type", "path", "code", "detail", "attempts")


def schedule(spark: SparkSession, policies: dict[str, RetryPolicy]) -> DataFrame:
    """Each attempt of each policy: policy, attempt, retried, delay_ms (null after the last)."""
    parts = []
    for name, policy in policies.items():
        rows = spark.range(1, policy.max_attempts + 1).select(F.lit(name).alias("policy"), F.col("id").alias("attempt"))
        retried = F.col("attempt") < policy.max_attempts
        parts.append(rows.select("policy", "attempt", retried.alias("retried"), F.when(retried, policy.delay(F.col("attempt"))).alias("delay_ms")))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def report(failures: DataFrame) -> DataFrame:
    """Failures by phase and code: items, attempts, the first and last time."""
    return failures.groupBy("phase", "code").agg(
        F.count(F.lit(1)).alias("items"), F.sum("attempts").alias("attempts"), F.min("time").alias("first"), F.max("time").alias("last")
    )


def write(failures: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write failure rows as CSV (with header), JSON or XML (one `failure` element a row)."""
    rows = failures.select(*COLUMNS).write.mode("overwrite")
    if fmt == "csv":
        rows.option("header", True).csv(path)
    elif fmt == "json":
        rows.json(path)
    elif fmt == "xml":
        rows.format("xml").option("rootTag", "failures").option("rowTag", "failure").save(path)
    else:
        raise ValueError(fmt)
