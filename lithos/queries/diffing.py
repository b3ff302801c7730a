"""Queries over two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos import catalog
from lithos.catalog import with_views
from lithos.operators import diff, ranking
from lithos.queries import query

_VIEWS = ("prev_dirs", "curr_dirs", "prev_files", "curr_files")
_FILES = """, fd AS (SELECT coalesce(p.dir_id, c.dir_id) AS dir_id, coalesce(p.name, c.name) AS name, p.hash AS prev_hash, c.hash AS curr_hash,
        CASE WHEN p.dir_id IS NULL THEN 'New' WHEN c.dir_id IS NULL THEN 'Deleted' WHEN p.hash <> c.hash THEN 'DataModified' ELSE 'Same' END AS diff
        FROM prev_files p FULL JOIN curr_files c ON p.dir_id = c.dir_id AND p.name = c.name),
    fc AS (SELECT dir_id, name, diff FROM fd WHERE diff <> 'Same' AND dir_id IN (SELECT p.dir_id FROM prev_dirs p JOIN curr_dirs c USING (dir_id)))"""
_DIRS = _FILES + """, dd AS (SELECT * FROM (SELECT coalesce(p.dir_id, c.dir_id) AS dir_id, coalesce(c.path, p.path) AS path,
        CASE WHEN p.dir_id IS NULL THEN 'New' WHEN c.dir_id IS NULL THEN 'Deleted'
            WHEN p.hash <> c.hash OR coalesce(np.n, 0) <> coalesce(nc.n, 0) OR ch.n > 0 THEN 'MetaModified' END AS diff,
        coalesce(nc.n, 0)::BIGINT AS files_count
        FROM prev_dirs p FULL JOIN curr_dirs c ON p.dir_id = c.dir_id
        LEFT JOIN (SELECT dir_id, count(*) AS n FROM prev_files GROUP BY 1) np ON np.dir_id = coalesce(p.dir_id, c.dir_id)
        LEFT JOIN (SELECT dir_id, count(*) AS n FROM curr_files GROUP BY 1) nc ON nc.dir_id = coalesce(p.dir_id, c.dir_id)
        LEFT JOIN (SELECT dir_id, count(*) AS n FROM fc GROUP BY 1) ch ON ch.dir_id = coalesce(p.dir_id, c.dir_id)) WHERE diff IS NOT NULL)"""
_COPY = _DIRS + """, plan AS (SELECT 'DIR' AS kind, dir_id, path AS dir_path, NULL::VARCHAR AS name, diff, files_count FROM dd WHERE diff <> 'Deleted'
    UNION ALL SELECT 'FILE', f.dir_id, d.path, f.name, f.diff, NULL FROM (
        SELECT dir_id, name, diff FROM fc WHERE diff <> 'Deleted'
        UNION ALL SELECT dir_id, name, 'New' FROM curr_files WHERE dir_id IN (SELECT dir_id FROM dd WHERE diff = 'New')) f
        JOIN curr_dirs d USING (dir_id))"""
_DELETE = _FILES + """, del AS (SELECT 'Dir' AS entry_type, path FROM prev_dirs WHERE dir_id NOT IN (SELECT dir_id FROM curr_dirs)
    UNION ALL SELECT 'File', d.path || '/' || name FROM fc JOIN curr_dirs d USING (dir_id) WHERE diff = 'Deleted')"""


def _four(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return catalog.prev_dirs(spark, sf), catalog.curr_dirs(spark, sf), catalog.prev_files(spark, sf), catalog.curr_files(spark, sf)


@query(with_views(_DIRS + " SELECT dir_id, path, diff, files_count FROM dd", *_VIEWS))
def dir_diff_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return diff.diff_dirs(*_four(spark, sf))


@query(with_views(_FILES + " SELECT dir_id, name, diff, prev_hash, curr_hash FROM fd", *_VIEWS))
def file_diff_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return diff.diff_files(catalog.prev_files(spark, sf), catalog.curr_files(spark, sf))


@query(with_views(
    """SELECT coalesce(p.dir_id, c.dir_id) AS id, CASE WHEN c.dir_id IS NULL THEN 'Deleted' ELSE 'New' END AS diff
    FROM prev_dirs p FULL JOIN curr_dirs c ON p.dir_id = c.dir_id WHERE p.dir_id IS NULL OR c.dir_id IS NULL""", "prev_dirs", "curr_dirs"))  # fmt: skip
def sorted_id_diff(spark: SparkSession, sf: str) -> DataFrame:
    ids = lambda df: df.select(F.col("dir_id").alias("id"))
    return diff.diff_ids(ids(catalog.prev_dirs(spark, sf)), ids(catalog.curr_dirs(spark, sf)))


@query(with_views(
    _DIRS + """ SELECT d.*, (f.n + files_of_new)::BIGINT AS files_new, f.files_modified, f.files_deleted FROM
    (SELECT count(*) FILTER (diff = 'New')::BIGINT AS dirs_new, count(*) FILTER (diff = 'MetaModified')::BIGINT AS dirs_modified,
        count(*) FILTER (diff = 'Deleted')::BIGINT AS dirs_deleted, coalesce(sum(files_count) FILTER (diff = 'New'), 0) AS files_of_new FROM dd) d,
    (SELECT count(*) FILTER (diff = 'New') AS n, count(*) FILTER (diff = 'DataModified')::BIGINT AS files_modified,
        count(*) FILTER (diff = 'Deleted')::BIGINT AS files_deleted FROM fc) f""".replace("d.*", "dirs_new, dirs_modified, dirs_deleted"), *_VIEWS))  # fmt: skip
def diff_stats(spark: SparkSession, sf: str) -> DataFrame:
    return diff.diff_stats(*_four(spark, sf))


@query(with_views(_COPY + " SELECT kind, dir_id, dir_path, name, diff, files_count FROM plan", *_VIEWS))
def copy_plan_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return diff.copy_plan(*_four(spark, sf))


@query(with_views(
    _DELETE + """ SELECT entry_type, path, CASE WHEN entry_type = 'File' THEN 1 ELSE 2 END::INTEGER AS phase,
        row_number() OVER (PARTITION BY split_part(path, '/', 3), entry_type ORDER BY path DESC)::BIGINT AS rank FROM del""", *_VIEWS))  # fmt: skip
def delete_plan_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Deletions with their order: files before directories, children before parents, by root."""
    rows = diff.delete_plan(*_four(spark, sf)).withColumn("root", F.element_at(F.split("path", "/"), 3))
    ranked = ranking.ranks(rows, ["root", "entry_type"], F.col("path").desc(), "rank")
    return ranked.select("entry_type", "path", F.when(F.col("entry_type") == "File", 1).otherwise(2).alias("phase"), "rank")


@query(with_views(
    """, s AS (SELECT id, path, size, checksum, id % 17 = 0 AS link, CASE WHEN id % 17 = 0 THEN 't' || id END AS tgt, id % 23 = 0 AS dir, size AS mtime FROM vdocs WHERE id % 11 <> 0),
    t AS (SELECT id, path, size + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN id % 7 = 0 THEN 'x' ELSE checksum END AS checksum, id % 17 = 0 AND id % 2 = 0 AS link,
        CASE WHEN id % 17 = 0 AND id % 2 = 0 THEN CASE WHEN id % 3 = 0 THEN 'u' ELSE 't' || id END END AS tgt, id % 23 = 0 AS dir, size + id % 2 AS mtime FROM vdocs WHERE id % 13 <> 0)
    SELECT coalesce(s.path, t.path) AS path, CASE WHEN t.path IS NULL THEN 'source_only' WHEN s.path IS NULL THEN 'target_only' WHEN s.link <> t.link THEN 'symlink_mismatch'
        WHEN s.link THEN CASE WHEN s.tgt = t.tgt THEN 'identical' ELSE 'symlink_mismatch' END WHEN s.size <> t.size THEN 'size_mismatch'
        WHEN s.checksum <> t.checksum THEN 'checksum_mismatch' ELSE 'identical' END AS status,
        coalesce(s.dir AND t.dir AND s.mtime <> t.mtime, false) AS mtime_mismatch
    FROM s FULL JOIN t ON s.path = t.path""", "vdocs"))  # fmt: skip
def tree_compare(spark: SparkSession, sf: str) -> DataFrame:
    docs, n = catalog.docs(spark, sf), F.col("id")

    def side(rows: DataFrame, link, target, size, checksum, mtime) -> DataFrame:
        return rows.select(
            "path", link.alias("is_symlink"), F.when(link, target).alias("symlink_target"), (n % 23 == 0).alias("is_dir"),
            size.alias("size"), checksum.alias("checksum"), mtime.alias("mtime"),
        )

    own = F.concat(F.lit("t"), n.cast("string"))
    source = side(docs.filter("id % 11 <> 0"), n % 17 == 0, own, F.col("size"), F.col("checksum"), F.col("size"))
    target = side(
        docs.filter("id % 13 <> 0"), (n % 17 == 0) & (n % 2 == 0), F.when(n % 3 == 0, "u").otherwise(own),
        F.col("size") + F.when(n % 5 == 0, 1).otherwise(0), F.when(n % 7 == 0, "x").otherwise(F.col("checksum")), F.col("size") + n % 2,
    )
    return diff.compare_trees(source, target, compare_mtime=True)


@query(with_views("SELECT dir_id, name, hash FROM prev_files INTERSECT SELECT dir_id, name, hash FROM curr_files", "prev_files", "curr_files"))
def unchanged_intersect(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["dir_id", "name", "hash"]
    return catalog.prev_files(spark, sf).select(*keys).intersect(catalog.curr_files(spark, sf).select(*keys))


@query(with_views("SELECT dir_id, name FROM curr_files EXCEPT SELECT dir_id, name FROM prev_files", "prev_files", "curr_files"))
def set_new_except(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["dir_id", "name"]
    return catalog.curr_files(spark, sf).select(*keys).join(catalog.prev_files(spark, sf).select(*keys), keys, "left_anti")


@query("""
    SELECT conv_id, arg_max(turn, turn)::BIGINT AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id""")
def dedup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    from lithos.operators.packing import last_wins

    return last_wins(catalog.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn")
