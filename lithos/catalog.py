"""Virtual file catalogs over the driver tables.

Each view exists twice: as a DataFrame and as the SQL text (for an ANSI engine)
that defines the same rows, so that queries and their oracles start alike.
Snapshots `prev` and `curr` derive from the same tables by key arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone; independent of the session's zone."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories: dir_id, path, mtime, price_c (stands in for a metadata hash)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dir_id"),
        F.concat(F.lit("/ds/"), F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"),
        epoch(F.col("o_orderdate")).alias("mtime"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("price_c"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, one per (order, line): dir_id, line, id, name, size, links, mtime, hash."""
    lines = table(spark, sf_dir, "lineitem")
    return (
        lines.groupBy(F.col("l_orderkey").alias("dir_id"), F.col("l_linenumber").cast("long").alias("line"))
        .agg(
            F.sum(F.col("l_quantity").cast("long") * 1024).alias("size"),
            F.count(F.lit(1)).alias("links"),
            F.max(epoch(F.col("l_shipdate"))).alias("mtime"),
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("hash"),
        )
        .select(
            "dir_id", "line", (F.col("dir_id") * 8 + F.col("line")).alias("id"),
            F.concat(F.lit("f"), F.col("line").cast("string"), F.lit(".dat")).alias("name"), "size", "links", "mtime", "hash",
        )
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: id, dir, name, path, size, checksum."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("dir"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("checksum"),
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as paths: id, url, path (no scheme, query or fragment; starts with a slash)."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.concat(F.lit("/"), F.rtrim(bare, F.lit("/"))).alias("path"))


def prev_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirs(spark, sf_dir).filter("dir_id % 10 <> 0").select("dir_id", "path", F.col("price_c").alias("hash"))


def curr_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("dir_id") % 5 == 0, 1).otherwise(0)
    return dirs(spark, sf_dir).filter("dir_id % 7 <> 0").select("dir_id", "path", (F.col("price_c") + changed).alias("hash"))


def prev_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter("dir_id % 10 <> 0 AND (dir_id + line) % 11 <> 0").select("dir_id", "name", "hash", "size", "mtime")


def curr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when((F.col("dir_id") % 5 == 0) & (F.col("line") % 2 == 0), 1).otherwise(0)
    kept = files(spark, sf_dir).filter("dir_id % 7 <> 0 AND (dir_id + line) % 13 <> 0")
    return kept.select("dir_id", "name", (F.col("hash") + changed).alias("hash"), "size", (F.col("mtime") + changed * 60).alias("mtime"))


# The same views as SQL, each a common table expression.
_SQL = {
    "vdirs": """SELECT o_orderkey AS dir_id, '/ds/' || replace(o_orderpriority, ' ', '_') || '/' || o_orderkey AS path,
        epoch(o_orderdate)::BIGINT AS mtime, round(o_totalprice * 100)::BIGINT AS price_c FROM orders""",
    "vfiles": """SELECT l_orderkey AS dir_id, l_linenumber::BIGINT AS line, (l_orderkey * 8 + l_linenumber)::BIGINT AS id,
        'f' || l_linenumber || '.dat' AS name, sum(l_quantity::BIGINT * 1024)::BIGINT AS size, count(*)::BIGINT AS links,
        max(epoch(l_shipdate)::BIGINT) AS mtime, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS hash
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "vdocs": """SELECT doc_id AS id, '/' || source || '/' || lang AS dir, doc_id || '.txt' AS name,
        '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS size, sha256(text) AS checksum FROM documents""",
    "vurls": """SELECT page_id AS id, url,
        '/' || rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM pages""",
    "prev_dirs": "SELECT dir_id, path, price_c AS hash FROM vdirs WHERE dir_id % 10 <> 0",
    "curr_dirs": "SELECT dir_id, path, price_c + CASE WHEN dir_id % 5 = 0 THEN 1 ELSE 0 END AS hash FROM vdirs WHERE dir_id % 7 <> 0",
    "prev_files": "SELECT dir_id, name, hash, size, mtime FROM vfiles WHERE dir_id % 10 <> 0 AND (dir_id + line) % 11 <> 0",
    "curr_files": """SELECT dir_id, name, hash + c AS hash, size, mtime + c * 60 AS mtime
        FROM (SELECT *, CASE WHEN dir_id % 5 = 0 AND line % 2 = 0 THEN 1 ELSE 0 END AS c FROM vfiles)
        WHERE dir_id % 7 <> 0 AND (dir_id + line) % 13 <> 0""",
}
_NEEDS = {"prev_dirs": "vdirs", "curr_dirs": "vdirs", "prev_files": "vfiles", "curr_files": "vfiles"}


def with_views(sql: str, *names: str) -> str:
    """SQL text preceded by the views that it uses (and those that they use); sql may itself go on with `, x AS (...)`."""
    wanted: list[str] = []
    for name in names:
        for part in (_NEEDS.get(name), name):
            if part and part not in wanted:
                wanted.append(part)
    views = ", ".join(f"{name} AS ({_SQL[name]})" for name in wanted)
    return f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{views} {sql.replace('RECURSIVE', '')}"
