"""Synthetic filesets: how many files a recipe makes, and their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def estimate(recipes: DataFrame) -> DataFrame:
    """Directories, files and bytes of recipes (name, depth, dirs, files, size): a geometric series over levels."""
    levels = recipes.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    above = F.round(F.pow(F.col("dirs").cast("double"), "level")).cast("long")
    per = levels.select("name", (above * F.col("dirs")).alias("d"), (above * F.col("files")).alias("f"), (above * F.col("files") * F.col("size")).alias("b"))
    return per.groupBy("name").agg(F.sum("d").alias("n_dirs"), F.sum("f").alias("n_files"), F.sum("b").alias("bytes"))


def generate(spark: SparkSession, depth: int, dirs: int, files: int, size: int) -> DataFrame:
    """The files of a recipe: path, level, size. A directory's path spells its number in base `dirs`."""
    levels = [spark.range(dirs**level).select(F.lit(level).alias("level"), F.col("id").alias("number")) for level in range(depth)]
    all_dirs = levels[0]
    for df in levels[1:]:
        all_dirs = all_dirs.unionByName(df)
    steps = F.when(F.col("level") > 0, F.sequence(F.lit(1), F.col("level"))).otherwise(F.array().cast("array<int>"))
    digit = lambda k: F.floor(F.col("number") / F.pow(F.lit(dirs), F.col("level") - k)).cast("long") % dirs
    path = F.array_join(F.transform(steps, lambda k: F.concat(F.lit("/dir_"), k.cast("string"), F.lit("_"), digit(k).cast("string"))), "")
    rows = all_dirs.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(files - 1))))
    name = F.concat(F.lit("/file_"), F.col("level").cast("string"), F.lit("_"), F.col("n").cast("string"), F.lit(".dat"))
    return rows.select(F.concat(path, name).alias("path"), "level", F.lit(size).cast("long").alias("size"))
