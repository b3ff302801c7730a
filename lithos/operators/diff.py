"""Snapshot differences: directories, files of matched directories, plans and statistics.

The four tables of two snapshots are united and grouped by (dir_id, name) once, which
is the full outer join of both levels in one shuffle that no large directory can skew.
What concerns a whole directory is a second, map-side combined aggregation; plans
with file rows join the two by dir_id, over the shuffle that is there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_snapshots(prev_dirs: DataFrame, curr_dirs: DataFrame, prev_files: DataFrame, curr_files: DataFrame) -> DataFrame:
    """One row per directory (name null) and per file of either snapshot, with both sides' hash and path.

    Directories: dir_id, path, hash. Files: dir_id, name, hash; of rows that repeat a key the greatest hash counts.
    """

    def side(df: DataFrame, prev: bool, is_dir: bool) -> DataFrame:
        none, path = F.lit(None).cast("long"), F.col("path") if is_dir else F.lit(None).cast("string")
        return df.select(
            "dir_id", F.lit(None).cast("string").alias("name") if is_dir else F.col("name"),
            F.lit(prev).alias("in_prev"), F.lit(not prev).alias("in_curr"),
            (F.col("hash") if prev else none).alias("prev_hash"), (none if prev else F.col("hash")).alias("curr_hash"),
            (path if prev else F.lit(None).cast("string")).alias("prev_path"), (F.lit(None).cast("string") if prev else path).alias("curr_path"),
        )

    rows = side(prev_dirs, True, True).unionByName(side(curr_dirs, False, True))
    rows = rows.unionByName(side(prev_files, True, False)).unionByName(side(curr_files, False, False))
    one = rows.groupBy("dir_id", "name").agg(*[F.max(c).alias(c) for c in rows.columns[2:]])
    kind = (
        F.when(~F.col("in_prev"), "New")
        .when(~F.col("in_curr"), "Deleted")
        .when(~F.col("prev_hash").eqNullSafe(F.col("curr_hash")), "DataModified")
        .otherwise("Same")
    )
    return one.withColumn("diff", kind)


def _directories(merged: DataFrame) -> DataFrame:
    """Per directory id: where it is, its paths, whether its own row differs, and its files by state."""
    is_dir, state = F.col("name").isNull(), F.col("diff")
    count = lambda condition: F.count_if(~is_dir & condition)
    return merged.groupBy("dir_id").agg(
        F.coalesce(F.max(F.when(is_dir, F.col("in_prev"))), F.lit(False)).alias("dir_prev"),
        F.coalesce(F.max(F.when(is_dir, F.col("in_curr"))), F.lit(False)).alias("dir_curr"),
        F.max("prev_path").alias("dir_prev_path"), F.max("curr_path").alias("dir_curr_path"),
        F.coalesce(F.max(F.when(is_dir, state == "DataModified")), F.lit(False)).alias("dir_changed"),
        count(F.col("in_prev")).alias("n_prev"), count(F.col("in_curr")).alias("n_curr"),
        count(state == "New").alias("n_new"), count(state == "DataModified").alias("n_modified"), count(state == "Deleted").alias("n_deleted"),
    )


def _with_state(merged: DataFrame) -> DataFrame:
    """Directory rows with their state: New, Deleted, MetaModified, or null if nothing differs."""
    differs = F.col("dir_changed") | (F.col("n_prev") != F.col("n_curr")) | (F.col("n_new") + F.col("n_modified") + F.col("n_deleted") > 0)
    state = F.when(~F.col("dir_prev"), "New").when(~F.col("dir_curr"), "Deleted").when(differs, "MetaModified")
    return _directories(merged).filter("dir_prev OR dir_curr").withColumn("dir_diff", state)


def diff_files(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Full outer join of files on (dir_id, name): diff is New, Deleted, DataModified or Same.

    Inputs: dir_id, name, hash. Returns dir_id, name, diff, prev_hash, curr_hash.
    """
    none = prev.limit(0).select("dir_id", F.lit(None).cast("string").alias("path"), "hash")
    return merge_snapshots(none, none, prev, curr).select("dir_id", "name", "diff", "prev_hash", "curr_hash")


def file_changes(prev_dirs: DataFrame, curr_dirs: DataFrame, prev_files: DataFrame, curr_files: DataFrame) -> DataFrame:
    """Files that differ inside directories of both snapshots: dir_id, name, diff."""
    merged = merge_snapshots(prev_dirs, curr_dirs, prev_files, curr_files)
    matched = _directories(merged).filter("dir_prev AND dir_curr").select("dir_id")
    return merged.filter("name IS NOT NULL AND diff <> 'Same'").join(matched, "dir_id", "left_semi").select("dir_id", "name", "diff")


def diff_dirs(prev_dirs: DataFrame, curr_dirs: DataFrame, prev_files: DataFrame, curr_files: DataFrame) -> DataFrame:
    """Directories that are New, Deleted or MetaModified (own hash, number of files or any file differs).

    Returns dir_id, path (the previous one if deleted), diff, files_count.
    """
    rows = _with_state(merge_snapshots(prev_dirs, curr_dirs, prev_files, curr_files)).filter("dir_diff IS NOT NULL")
    path = F.coalesce("dir_curr_path", "dir_prev_path").alias("path")
    return rows.select("dir_id", path, F.col("dir_diff").alias("diff"), F.col("n_curr").alias("files_count"))


def copy_plan(prev_dirs: DataFrame, curr_dirs: DataFrame, prev_files: DataFrame, curr_files: DataFrame) -> DataFrame:
    """What an incremental run copies: rows of kind DIR and FILE with explicit directories.

    A New directory comes with all its files; a MetaModified one with its new and changed files.
    """
    merged = merge_snapshots(prev_dirs, curr_dirs, prev_files, curr_files)
    changed = _with_state(merged).filter("dir_diff IN ('New', 'MetaModified')").select("dir_id", "dir_diff", F.col("dir_curr_path").alias("dir_path"), "n_curr")
    rows = merged.join(changed, "dir_id")
    is_dir = F.col("name").isNull()
    state = F.when(is_dir | (F.col("dir_diff") == "New"), F.col("dir_diff")).otherwise(F.col("diff"))
    wanted = F.when(F.col("dir_diff") == "New", F.col("in_curr")).otherwise(F.col("diff").isin("New", "DataModified"))
    return rows.filter(is_dir | wanted).select(
        F.when(is_dir, "DIR").otherwise("FILE").alias("kind"), "dir_id", "dir_path", "name", state.alias("diff"),
        F.when(is_dir, F.col("n_curr")).alias("files_count"),
    )


def delete_plan(prev_dirs: DataFrame, curr_dirs: DataFrame, prev_files: DataFrame, curr_files: DataFrame) -> DataFrame:
    """What an incremental run deletes: entry_type and path. Files of deleted directories are not listed."""
    merged = merge_snapshots(prev_dirs, curr_dirs, prev_files, curr_files)
    dirs = _directories(merged).select("dir_id", (F.col("dir_prev") & F.col("dir_curr")).alias("matched"), "dir_curr_path")
    rows = merged.filter("diff = 'Deleted'").join(dirs, "dir_id")
    is_dir = F.col("name").isNull()
    path = F.when(is_dir, F.col("prev_path")).otherwise(F.concat("dir_curr_path", F.lit("/"), "name"))
    return rows.filter(is_dir | F.col("matched")).select(F.when(is_dir, "Dir").otherwise("File").alias("entry_type"), path.alias("path"))


def diff_stats(prev_dirs: DataFrame, curr_dirs: DataFrame, prev_files: DataFrame, curr_files: DataFrame) -> DataFrame:
    """One row: new, modified and deleted directories and files; files of new directories count as new."""
    rows = _with_state(merge_snapshots(prev_dirs, curr_dirs, prev_files, curr_files))
    both = F.col("dir_prev") & F.col("dir_curr")
    total = lambda c: F.coalesce(F.sum(F.when(both, F.col(c))), F.lit(0))
    of_new = F.coalesce(F.sum(F.when(F.col("dir_diff") == "New", F.col("n_curr"))), F.lit(0))
    return rows.agg(
        *[F.count_if(F.col("dir_diff") == k).alias(f"dirs_{n}") for k, n in (("New", "new"), ("MetaModified", "modified"), ("Deleted", "deleted"))],
        (total("n_new") + of_new).alias("files_new"), total("n_modified").alias("files_modified"), total("n_deleted").alias("files_deleted"),
    )


def diff_ids(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Ids of one side only: id, diff (Deleted or New)."""
    p, c = prev.select("id", F.lit(True).alias("__p")), curr.select("id", F.lit(True).alias("__c"))
    kind = F.when(F.col("__c").isNull(), "Deleted").when(F.col("__p").isNull(), "New")
    return p.join(c, "id", "full_outer").select("id", kind.alias("diff")).filter("diff IS NOT NULL")


def compare_trees(source: DataFrame, target: DataFrame, compare_mtime: bool = False) -> DataFrame:
    """Full outer join of two trees on path: path, status by the first rule that holds, and mtime_mismatch.

    Inputs: path, is_symlink, symlink_target, is_dir, size, checksum, mtime.
    """
    rename = lambda df, p: df.select(F.struct(*[c for c in df.columns if c != "path"]).alias(p), "path")
    both = rename(source, "s").join(rename(target, "t"), "path", "full_outer")
    s, t = F.col("s"), F.col("t")
    link = F.when(s["symlink_target"].eqNullSafe(t["symlink_target"]), "identical").otherwise("symlink_mismatch")
    status = (
        F.when(t.isNull(), "source_only")
        .when(s.isNull(), "target_only")
        .when(s["is_symlink"] != t["is_symlink"], "symlink_mismatch")
        .when(s["is_symlink"], link)
        .when(s["size"] != t["size"], "size_mismatch")
        .when(~s["checksum"].eqNullSafe(t["checksum"]), "checksum_mismatch")
        .otherwise("identical")
    )
    late = F.coalesce(F.lit(compare_mtime) & s["is_dir"] & t["is_dir"] & (s["mtime"] != t["mtime"]), F.lit(False))
    return both.select("path", status.alias("status"), late.alias("mtime_mismatch"))
