"""A Python Data Source over a directory tree: format `fstree`.

    spark.dataSource.register(FsTree)
    spark.read.format("fstree").load("/data")

Options: scan_hidden, skip_names, max_depth, follow_symlinks, include_dirs,
include_files, exclude_dirs, exclude_files (patterns, separated by commas). The
subtrees below the root are the partitions; each is walked with a stack, and a
directory that no pattern lets in is not entered. Links to directories are
followed only on request, each real directory once a partition.
"""

from __future__ import annotations

import base64
import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "kind string, dir string, name string, path string, depth int, id long, devno long, mode long, size long, links long, blocks long,"
    " atime long, ctime long, mtime long, uid long, gid long, symlink_target string, xattributes string"
)
#: Subtrees are cut until there are at least this many partitions, or no directories are left.
PARTITIONS = 64


def _segments(path: str) -> list[str]:
    return [s for s in path.split("/") if s not in ("", ".")]


def _matches(segment: str, pattern: str) -> bool:
    if "*" not in pattern:
        return segment.startswith(pattern) and segment.endswith(pattern)
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), segment, re.S) is not None


class Rules:
    """The pattern rules of lithos.operators.filters, on plain strings, for use while walking."""

    def __init__(self, options: dict[str, str]) -> None:
        get = lambda key: [_segments(p) for p in options.get(key, "").split(",") if p.strip()]
        self.include_dirs, self.include_files = get("include_dirs"), get("include_files")
        self.exclude_dirs, self.exclude_files = get("exclude_dirs"), get("exclude_files")

    @staticmethod
    def _prefix(parts: list[str], pattern: list[str]) -> bool:
        return all(map(_matches, parts, pattern))

    def _under(self, parts: list[str], patterns: list[list[str]]) -> bool:
        return any(len(parts) >= len(p) and self._prefix(parts, p) for p in patterns)

    def enter(self, path: str) -> bool:
        parts = _segments(path)
        if self._under(parts, self.exclude_dirs):
            return False
        if not (self.include_dirs or self.include_files):
            return True
        return any(self._prefix(parts, p) for p in self.include_dirs) or any(len(parts) < len(p) and self._prefix(parts, p) for p in self.include_files)

    def emit(self, path: str) -> bool:
        parts = _segments(path)
        exact = lambda patterns: any(len(parts) == len(p) and self._prefix(parts, p) for p in patterns)
        if self._under(parts, self.exclude_dirs) or exact(self.exclude_files):
            return False
        return not (self.include_dirs or self.include_files) or self._under(parts, self.include_dirs) or exact(self.include_files)


class _Subtree(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        super().__init__(path)
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.abspath(options["path"])
        self.rules = Rules(options)
        flag = lambda key: options.get(key, "false").lower() == "true"
        self.hidden, self.follow = flag("scan_hidden"), flag("follow_symlinks")
        self.skip = {x for x in options.get("skip_names", "").split(",") if x}
        self.max_depth = int(options.get("max_depth", "-1"))

    def _logical(self, path: str) -> str:
        return "/" + os.path.relpath(path, self.root) if path != self.root else "/"

    def _children(self, path: str) -> list[os.DirEntry]:
        """Entries of a directory in name order; none if it cannot be read."""
        try:
            with os.scandir(path) as entries:
                found = [e for e in entries if e.name not in self.skip and (self.hidden or not e.name.startswith("."))]
        except OSError:
            return []
        return sorted(found, key=lambda e: e.name)

    def _is_dir(self, entry: os.DirEntry) -> bool:
        return entry.is_dir(follow_symlinks=False) or (self.follow and entry.is_symlink() and os.path.isdir(entry.path))

    def _below(self, path: str) -> list[str]:
        depth = len(_segments(self._logical(path)))
        if 0 <= self.max_depth <= depth:
            return []
        return [e.path for e in self._children(path) if self._is_dir(e) and self.rules.enter(self._logical(e.path))]

    def partitions(self) -> list[InputPartition]:
        shallow: list[str] = []
        level = [self.root]
        while level and len(shallow) + len(level) < PARTITIONS:
            shallow += level
            level = [d for path in level for d in self._below(path)]
            if len(shallow) > 8 * PARTITIONS:
                break
        return [_Subtree(p, False) for p in shallow] + [_Subtree(p, True) for p in level]

    def _row(self, kind: str, path: str, st: os.stat_result) -> tuple:
        logical = self._logical(path)
        link = os.readlink(path) if stat.S_ISLNK(st.st_mode) else None
        attributes = []
        if not link and hasattr(os, "listxattr"):
            try:
                attributes = [f"{n}={base64.b64encode(os.getxattr(path, n)).decode()}" for n in os.listxattr(path)]
            except OSError:
                attributes = []
        regular = stat.S_ISREG(st.st_mode)
        return (
            kind, os.path.dirname(logical), os.path.basename(logical), logical, len(_segments(logical)), st.st_ino, st.st_dev, st.st_mode,
            st.st_size if regular else 0, st.st_nlink if regular else 1, getattr(st, "st_blocks", 0), int(st.st_atime), int(st.st_ctime), int(st.st_mtime),
            st.st_uid, st.st_gid, link, "\n".join(attributes) or None,
        )

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        stack, seen = [partition.path], set()
        while stack:
            path = stack.pop()
            try:
                st = os.stat(path)
            except OSError:
                continue
            if (st.st_dev, st.st_ino) in seen:
                continue
            seen.add((st.st_dev, st.st_ino))
            if self.rules.enter(self._logical(path)):
                yield self._row("dir", path, st)
            for entry in self._children(path):
                if entry.is_dir(follow_symlinks=False):
                    continue
                try:
                    own = entry.stat(follow_symlinks=False)
                except OSError:
                    continue
                if stat.S_ISLNK(own.st_mode) or stat.S_ISREG(own.st_mode):
                    if self.rules.emit(self._logical(entry.path)):
                        yield self._row("symlink" if stat.S_ISLNK(own.st_mode) else "file", entry.path, own)
            if partition.deep:
                stack.extend(reversed(self._below(path)))


class FsTree(DataSource):
    """Directories, files and links below a path."""

    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def checksums(spark, root: str) -> DataFrame:  # noqa: ANN001
    """Files below a folder of any store: path (below the folder), size, mtime, checksum (SHA-256 of the content). Hidden names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = re.sub(r"^[a-z0-9+.-]+:/+", "/", root.rstrip("/"))
    plain = F.regexp_replace("path", "^[a-z0-9+.-]+:/+", "/")
    return files.select(
        F.substring(plain, len(bare) + 1, 1 << 30).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("checksum")
    )
