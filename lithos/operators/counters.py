"""Counters of scans, transfers, restores and phases, each one aggregation over rows of what happened.

A null size counts as 0 bytes; an empty table gives a row of zeros (no row where counters are by phase).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _bytes(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("size"))), F.lit(0))


def scan_counters() -> dict[str, Column]:
    """Over entries (kind file or dir, size, failed, is_root): bytes, files, directories and failures; roots are not counted."""
    ok, is_file = ~F.col("failed"), F.col("kind") == "file"
    return {
        "tot_size": _bytes(is_file & ok), "tot_files": F.count_if(is_file & ok), "tot_dirs": F.count_if(~is_file & ok & ~F.col("is_root")),
        "failed_files": F.count_if(is_file & ~ok), "failed_dirs": F.count_if(~is_file & ~ok),
    }


def transfer_counters() -> dict[str, Column]:
    """Over steps (op, kind, size, failed): the eleven counters of a transfer.

    ops: copy, delete, mkdir. A copy opens and closes its source, then its target; one that failed at its
    target (failed = target) has opened and closed the source only, one that failed at its source nothing.
    """
    failed, is_dir = F.col("failed"), F.col("kind") == "dir"
    copy, done = F.col("op") == "copy", F.col("failed").isNull()
    source = copy & (done | (failed == "target"))
    return {
        "bytes_copied": _bytes(copy & done), "src_opened": F.count_if(source), "src_closed": F.count_if(source),
        "dst_opened": F.count_if(copy & done), "dst_closed": F.count_if(copy & done), "files_copied": F.count_if(copy & done),
        "files_deleted": F.count_if((F.col("op") == "delete") & ~is_dir & done), "dirs_created": F.count_if((F.col("op") == "mkdir") & done),
        "dirs_deleted": F.count_if((F.col("op") == "delete") & is_dir & done), "files_failed": F.count_if(~done & ~is_dir), "dirs_failed": F.count_if(~done & is_dir),
    }


def restore_counters() -> dict[str, Column]:
    """Over entries (kind, size, should, failed): what was restored, skipped by policy, and failed."""
    is_file, wanted, failed = F.col("kind") == "file", F.col("should"), F.col("failed")
    done, skipped = is_file & wanted & ~failed, is_file & ~wanted
    return {
        "files_restored": F.count_if(done), "bytes_restored": _bytes(done), "files_skipped": F.count_if(skipped), "bytes_skipped": _bytes(skipped),
        "files_failed": F.count_if(is_file & wanted & failed), "dirs_created": F.count_if(~is_file & ~failed),
    }


def phase_counters(rows: DataFrame) -> DataFrame:
    """Rows (phase, action, failed) by phase: processed, ok, failed and skipped; actions that start with skip do nothing."""
    skipped = F.startswith("action", F.lit("skip")) | (F.col("action") == "primary")
    return rows.groupBy("phase").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(~skipped & ~F.col("failed")).alias("ok"), F.count_if(~skipped & F.col("failed")).alias("failed"),
        F.count_if(skipped).alias("skipped"),
    )


def counted(rows: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row of counters."""
    return rows.agg(*[c.alias(n) for n, c in counters.items()])


def observed(rows: DataFrame, counters: dict[str, Column], name: str) -> tuple[DataFrame, Observation]:
    """rows, and an observation that holds the counters once an action has run over them: counting costs no second pass."""
    watch = Observation(name)
    return rows.observe(watch, *[c.alias(n) for n, c in counters.items()]), watch


def by_status(compared: DataFrame) -> DataFrame:
    """Compared entries (path, status, mtime_mismatch) by status, with a row for directories whose times differ."""
    times = compared.filter("mtime_mismatch").select(F.lit("mtime_mismatch").alias("status"))
    return compared.select("status").unionByName(times).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
