"""Writers of catalogs, plans, blob indexes and blobs, and readers of what they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.hashing import plan_shard
from lithos.operators.packing import last_wins


def write_catalog(files: DataFrame, dirs: DataFrame, path: str, snapshot_id: str, rows_per_file: int = 5_000_000) -> None:
    """Append a snapshot; a rerun replaces it. Files are sorted by directory, so ranges of directories prune."""
    for name, df in (("files", files), ("dirs", dirs)):
        rows = df.withColumn("snapshot_id", F.lit(snapshot_id)).sortWithinPartitions("dir_id")
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
        writer.partitionBy("snapshot_id").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, table: str, snapshot_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}").filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")


def write_plan(plan: DataFrame, path: str, shards: int, rows_per_file: int = 1_000_000) -> DataFrame:
    """Write a plan (kind, dir_path, ...) by shard of its directories; returns the header: rows by kind and shard."""
    rows = plan.withColumn("shard", plan_shard(F.col("dir_path"), shards))
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "dir_path", "kind")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
    return plan_header(plan.sparkSession.read.parquet(path))


def plan_header(plan: DataFrame) -> DataFrame:
    return plan.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count_if(F.col("kind") == "DIR").alias("dirs"), F.count_if(F.col("kind") == "FILE").alias("files"))


def rewrite_plan(spark: SparkSession, source: str, target: str, column: str, mapping) -> None:  # noqa: ANN001
    """Write a plan anew with one path column mapped; the source stays until the target is whole."""
    spark.read.parquet(source).withColumn(column, mapping(F.col(column))).write.mode("overwrite").parquet(target)


def write_dir_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Blob index rows (dir, name, seq, ...) by a hash of their directory; of rows of one name the last (by seq) stays.

    Rows of a bucket are sorted, so the scan skips row groups of other directories; files grow with buckets, not with directories.
    """
    rows = last_wins(index, ["dir", "name"], "seq").withColumn("bucket", _bucket(F.col("dir"), buckets))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "dir", "name").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _bucket(directory: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(directory), F.lit(buckets))


def read_dir_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def lookup_dir_index(spark: SparkSession, path: str, directory: str, name: str, buckets: int = 64) -> DataFrame:
    """One file's row: the directory's bucket prunes partitions, both names are pushed to the scan."""
    own = _bucket(F.lit(directory), buckets)
    return spark.read.parquet(path).filter((F.col("bucket") == own) & (F.col("dir") == directory) & (F.col("name") == name)).drop("bucket")


def blob_contents(rows: DataFrame) -> DataFrame:
    """Blobs from rows (bucket, blob, offset, content): the contents in the order of their offsets, and the size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "content")))
    # joined as characters of one byte each: one pass, where adding binaries up copies what is there for every part
    letters = F.transform(parts, lambda x: F.decode(x["content"], "ISO-8859-1"))
    content = F.encode(F.array_join(letters, ""), "ISO-8859-1")
    return rows.groupBy("bucket", "blob").agg(content.alias("content")).withColumn("size", F.octet_length("content"))


def read_from_blobs(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """Index rows (bucket, blob, offset, size, ...) with content; out_of_range where a blob is too short or missing."""
    found = index.join(blobs.select("bucket", "blob", F.col("content").alias("__b"), F.col("size").alias("__n")), ["bucket", "blob"], "left")
    out = F.col("__n").isNull() | (F.col("offset") + F.col("size") > F.col("__n"))
    part = F.substring(F.col("__b"), F.col("offset").cast("int") + 1, F.col("size").cast("int"))
    return found.withColumn("out_of_range", out).withColumn("content", F.when(~out, part)).drop("__b", "__n")


def stats_only(df: DataFrame) -> None:
    """Run a query for its observed metrics and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
