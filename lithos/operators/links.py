"""Hard links: groups of names that share storage, and which name is the primary one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan_groups(files: DataFrame) -> DataFrame:
    """Groups by (devno, id) of files with several links; link_count is the file's own, a group may have one name."""
    return (
        files.filter("links > 1")
        .groupBy("devno", "id")
        .agg(F.max("links").alias("link_count"), F.array_sort(F.collect_list(F.struct("seq", "path"))).alias("members"))
        .select("devno", "id", "link_count", F.col("members.path").alias("paths"))
    )


def restore_groups(files: DataFrame) -> DataFrame:
    """Groups of at least two names by (id, devno); link_count is the number of names."""
    return (
        files.groupBy("id", "devno")
        .agg(F.count(F.lit(1)).alias("link_count"), F.array_sort(F.collect_list(F.struct("seq", "path"))).alias("members"))
        .filter("link_count >= 2")
        .select("id", "devno", "link_count", F.col("members.path").alias("paths"))
    )


def link_actions(files: DataFrame, keys: list[str], order: str = "seq", usable: Column | None = None) -> DataFrame:
    """Per name of a group with at least two usable names: action (primary, link) and the primary's path.

    The first usable name in order is the primary; the others are linked to it.
    """
    rows = files if usable is None else files.filter(usable)
    group = Window.partitionBy(*keys)
    first = group.orderBy(order)
    out = rows.withColumn("members", F.count(F.lit(1)).over(group)).withColumn("rank", F.row_number().over(first))
    out = out.withColumn("primary_path", F.first("path").over(first)).filter("members >= 2")
    return out.withColumn("action", F.when(F.col("rank") == 1, "primary").otherwise("link")).drop("rank")


def already_linked(id_a: Column, dev_a: Column, id_b: Column, dev_b: Column) -> Column:
    return (id_a == id_b) & (dev_a == dev_b)
