"""Row numbers, running sums, forward fills and ranks that no key pulls into one task.

Each is built in two levels: rows fall into blocks of a long column (or of sorted
ranges), a window runs inside each block, and what the blocks before add up to, one row
a block, is joined to it. Nulls in a summed column count as 0; rows with a null in the
ordering column share a block of their own and come first; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.session import scratch

#: Values of the ordering column in a block.
BLOCK = 1 << 16


def _blocks(df: DataFrame, part: str, order: str, block: int) -> DataFrame:
    return df.withColumn("__p", F.col(part)).withColumn("__b", F.coalesce(F.floor(F.col(order) / block), F.lit(-(1 << 62))))


def _carried(blocks: DataFrame, value: Column) -> DataFrame:
    """Blocks (__p, __b, ...) with value over those before, as __before."""
    return blocks.select("__p", "__b", value.over(Window.partitionBy("__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))


def _joined(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    keys = [rows["__p"].eqNullSafe(blocks["__p"]), rows["__b"] == blocks["__b"]]
    return rows.join(blocks.withColumnRenamed("__before", "__x"), keys).drop("__p", "__b")


def running_sum(df: DataFrame, part: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with the sum of value over the rows of its part that come before each row, in the order of a unique long column."""
    rows = _blocks(df, part, order, block)
    blocks = _carried(rows.groupBy("__p", "__b").agg(F.coalesce(F.sum(value), F.lit(0)).alias("s")), F.sum("s"))
    inside = Window.partitionBy("__p", "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return _joined(rows, blocks).withColumn(name, (F.coalesce("__x", F.lit(0)) + F.col("__in")).cast("long")).drop("__x", "__in")


def row_numbers(df: DataFrame, part: str, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with the number (from 0) of each row in its part, in the order of a unique long column."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("long")), part, order, "__one", name, block).drop("__one")


def fill_forward(df: DataFrame, part: str, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with the last value that is not null up to each row of its part, in the order of a unique long column."""
    rows = _blocks(df.withColumn("__v", value), part, order, block)
    blocks = _carried(rows.groupBy("__p", "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("v")), F.last("v", ignorenulls=True))
    inside = Window.partitionBy("__p", "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.last("__v", ignorenulls=True).over(inside))
    return _joined(rows, blocks).withColumn(name, F.coalesce("__in", "__x")).drop("__x", "__in", "__v")


def ranks(df: DataFrame, keys: list[str], order: Column, name: str) -> DataFrame:
    """df with the rank (from 1) of each row among those of its keys, by an order that any type can give.

    Rows are dealt into sorted ranges, which are written down once, so that the counts of ranges and the
    numbers inside them are of the same ranges; ties get different numbers.
    """
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], order).withColumn("__b", F.spark_partition_id())
    path = scratch(df.sparkSession, "ranges")
    dealt.write.parquet(path)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(path)
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__x"))
    inside = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(order)))
    same = [inside[k].eqNullSafe(counts[f"__k{i}"]) for i, k in enumerate(keys)] + [inside["__b"] == counts["__c"]]
    out = inside.join(counts, same).withColumn(name, (F.col("__x") + F.col("__in")).cast("long"))
    return out.select(*df.columns, name)
