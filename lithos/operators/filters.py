"""Include and exclude filters over logical paths, compiled to Column expressions.

A pattern is an anchored path whose segments may hold `*` (within the segment). A
segment without `*` matches every segment that both starts and ends with it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _segments(path: str) -> list[str]:
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return out


def segment_matches(segment: Column, pattern: str) -> Column:
    if set(pattern) == {"*"}:
        return F.lit(True)
    if "*" not in pattern:
        return F.startswith(segment, F.lit(pattern)) & F.endswith(segment, F.lit(pattern))
    return F.rlike(segment, F.lit("(?s)^" + ".*".join(map(re.escape, pattern.split("*"))) + "$"))


def path_segments(path: Column) -> Column:
    """The segments of a logical path; none for `/`."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _compare(parts: Column, pattern: list[str], n: int | None = None) -> Column:
    """Whether the first n segments (all of the pattern's by default) match those that the path has."""
    hits = [F.coalesce(segment_matches(F.get(parts, F.lit(k)), p), F.lit(True)) for k, p in enumerate(pattern[:n])]
    return reduce(lambda a, b: a & b, hits, F.lit(True))


def _any(columns: list[Column]) -> Column:
    return reduce(or_, columns, F.lit(False))


@dataclass(frozen=True)
class PathFilter:
    """A compiled set of patterns; without any pattern every path passes."""

    include_dirs: Sequence[str] = ()
    include_files: Sequence[str] = ()
    exclude_dirs: Sequence[str] = ()
    exclude_files: Sequence[str] = ()

    def __post_init__(self) -> None:
        for group in (self.include_dirs, self.include_files, self.exclude_dirs, self.exclude_files):
            for pattern in group:
                if not pattern.strip():
                    raise ValueError("an empty pattern")

    @staticmethod
    def exact(parts: Column, pattern: str) -> Column:
        p = _segments(pattern)
        return (F.size(parts) == len(p)) & _compare(parts, p)

    @staticmethod
    def in_subtree(parts: Column, pattern: str) -> Column:
        p = _segments(pattern)
        return (F.size(parts) >= len(p)) & _compare(parts, p)

    @staticmethod
    def can_reach_dir(parts: Column, pattern: str) -> Column:
        """Whether a directory is a possible ancestor of a match, or inside one."""
        return _compare(parts, _segments(pattern))

    @staticmethod
    def can_reach_file(parts: Column, pattern: str) -> Column:
        """Whether a directory is a possible strict ancestor of a matching file."""
        p = _segments(pattern)
        return (F.size(parts) < len(p)) & _compare(parts, p)

    @property
    def _includes(self) -> bool:
        return bool(self.include_dirs or self.include_files)

    def emit_dir(self, path: Column) -> Column:
        parts = path_segments(path)
        excluded = _any([self.in_subtree(parts, p) for p in self.exclude_dirs])
        reached = [self.can_reach_dir(parts, p) for p in self.include_dirs] + [self.can_reach_file(parts, p) for p in self.include_files]
        return ~excluded & (_any(reached) if self._includes else F.lit(True))

    #: A directory is entered by the rule that emits it.
    descend_dir = emit_dir

    def emit_file(self, path: Column) -> Column:
        parts = path_segments(path)
        excluded = _any([self.in_subtree(parts, p) for p in self.exclude_dirs] + [self.exact(parts, p) for p in self.exclude_files])
        included = [self.in_subtree(parts, p) for p in self.include_dirs] + [self.exact(parts, p) for p in self.include_files]
        return ~excluded & (_any(included) if self._includes else F.lit(True))


def visible(name: Column, scan_hidden: bool = False, skip_names: Sequence[str] = ()) -> Column:
    """Whether an entry takes part in a scan: no dot entries, hidden names only on request, no skipped names."""
    keep = ~name.isin(".", "..")
    if not scan_hidden:
        keep &= ~F.startswith(name, F.lit("."))
    if skip_names:
        keep &= ~name.isin(*skip_names)
    return keep


def entry_kind(mode: Column) -> Column:
    """symlink, dir, file, block or special by the type bits of a unix mode."""
    kind = mode.bitwiseAND(F.lit(0xF000))
    return (
        F.when(kind == 0xA000, "symlink").when(kind == 0x4000, "dir").when(kind == 0x8000, "file").when(kind == 0x6000, "block").otherwise("special")
    )


def drop_empty_dirs(dirs: DataFrame, emitted: Column, n_files: Column) -> DataFrame:
    """Directories that pass the filters themselves or hold files."""
    return dirs.filter(emitted | (n_files > 0))


def within_depth(depth: Column, most: int | None) -> Column:
    return F.lit(True) if most is None else depth <= most


def should_aggregate(size: Column, threshold: int, enabled: bool = True, is_symlink: Column | None = None) -> Column:
    """Whether a file goes into a blob: not empty, under the threshold, no link."""
    out = F.lit(enabled) & (size > 0) & (size < threshold)
    return out if is_symlink is None else out & ~is_symlink


def should_aggregate_block(size: Column, offset: Column, length: Column, threshold: int) -> Column:
    """Whether a block goes into a blob: it holds the whole of such a file."""
    return should_aggregate(size, threshold) & (offset == 0) & (length == size)


def is_active(state: Column) -> Column:
    return state.isin("created", "starting", "running", "stopping")


def suppressed(target: Column, message: Column) -> Column:
    """Log records of closing a file on a share that is gone."""
    gone = F.contains(message, F.lit("Unexpected Message, Received message for different tree, or tree disconnecting."))
    deleted = F.contains(message, F.lit("Network Name Deleted (0xc00000c9)"))
    return (target == "smb::resource") & F.startswith(message, F.lit("Error closing file:")) & (gone | deleted)
