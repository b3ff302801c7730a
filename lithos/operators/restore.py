"""Restore decisions: overwrite policy, blob lookup, order of phases, delete and mtime applicability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.hashing import control_kind

#: The order in which phases run.
PHASES = ("copy", "hardlink", "delete", "mtime")


def should_restore(policy: Column, source_mtime: Column, target_exists: Column, target_mtime: Column) -> Column:
    """replace: always; skip: only what is missing; keep_newer: what is missing, newer, or of unknown target time."""
    newer = (
        F.when(~target_exists, True)
        .when(target_mtime.isNull(), True)
        .when(source_mtime.isNull(), False)
        .otherwise(source_mtime > target_mtime)
    )
    return F.when(policy == "replace", True).when(policy == "skip", ~target_exists).when(policy == "keep_newer", newer)


def lookup(files: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """Files with where they are restored from: source is blob (with blob, offset, size) or plain."""
    found = index.select(F.col(key), F.struct(*[c for c in index.columns if c != key]).alias("__i"))
    out = files.join(found, key, "left")
    fields = [F.col(f"__i.{c}").alias(c) for c in index.columns if c != key]
    return out.select(*files.columns, F.when(F.col("__i").isNotNull(), "blob").otherwise("plain").alias("source"), *fields)


def phase_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PHASES)), kind).cast("int")


def delete_action(entry_type: Column, exists: Column, is_dir: Column) -> Column:
    """What a delete row does at its target: skip what is missing or of the other kind."""
    fits = F.when(entry_type == "Dir", is_dir).otherwise(~is_dir)
    return F.when(~exists, "skip_missing").when(~fits, "skip_kind").when(entry_type == "Dir", "remove_dir").otherwise("remove_file")


def mtime_action(exists: Column) -> Column:
    return F.when(exists, "set").otherwise("skip_missing")


def copy_action(is_symlink: Column, remote: Column) -> Column:
    """Remote pipelines skip symbolic links, local ones create them."""
    return F.when(is_symlink & remote, "skip_symlink").when(is_symlink, "symlink").otherwise("copy")


def first_of_phases(names: DataFrame) -> DataFrame:
    """The first control file (column name) of each phase, by name: kind, name."""
    return names.withColumn("kind", control_kind(F.col("name"))).filter("kind IS NOT NULL").groupBy("kind").agg(F.min("name").alias("name"))
