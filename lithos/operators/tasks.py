"""Task states: transitions over an event table, limits on what is active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.operators.filters import is_active

#: States that nothing follows.
FINAL = ("completed", "failed", "killed", "stopped")


def next_state(event: Column) -> Column:
    """The state that an event leads to."""
    return (
        F.when(event == "create", "created").when(event == "start", "starting").when(event == "run", "running").when(event == "stop", "stopping")
        .when(event == "exit_ok", "completed").when(event == "exit_error", "failed").when(event == "kill", "killed").when(event == "signal", "stopped")
    )


def states(events: DataFrame, key: str, order: str) -> DataFrame:
    """Each task's state: that of its first final event, else of its last one."""
    rows = events.withColumn("state", next_state(F.col("event")))
    final = F.col("state").isin(*FINAL)
    return rows.groupBy(key, "kind").agg(
        F.coalesce(F.min_by("state", F.when(final, F.col(order))), F.max_by("state", order)).alias("state"), F.count(F.lit(1)).alias("events")
    )


def active_by_kind(tasks: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Active tasks of each kind and whether another is refused; backup and restore share a limit."""
    group = F.when(F.col("kind") == "scan", "scan").otherwise("subtask")
    rows = tasks.groupBy(group.alias("pool")).agg(F.count_if(is_active(F.col("state"))).alias("active"), F.count(F.lit(1)).alias("tasks"))
    most = F.when(F.col("pool") == "scan", limits["scan"]).otherwise(limits["subtask"])
    return rows.select("pool", "active", "tasks", (F.col("active") >= most).alias("refused"))


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event row of each key."""
    own = Window.partitionBy(key).orderBy(F.col(order).desc())
    return events.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")
