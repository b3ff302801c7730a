"""Tree source, binary readers, manifests, filesets, streams."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from lithos.sources import codec, fileset, manifest, sinks
from lithos.sources.fstree import FsTree
from lithos.streaming import ingest


@pytest.fixture()
def tree(tmp_path):
    for name in ("keep_dir/a.txt", "keep_dir/deep/b.csv", "skip_dir/c.txt", "root_file.txt", ".hidden"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 10)
    os.symlink("root_file.txt", tmp_path / "link")
    os.link(tmp_path / "root_file.txt", tmp_path / "hard.txt")
    os.symlink(tmp_path, tmp_path / "keep_dir" / "loop")
    return tmp_path


def _load(spark, path, **options):
    spark.dataSource.register(FsTree)
    return spark.read.format("fstree").options(**options).load(str(path))


def test_tree(spark, tree):
    rows = {r.path: r for r in _load(spark, tree).collect()}
    assert sorted(p for p, r in rows.items() if r.kind == "dir") == ["/", "/keep_dir", "/keep_dir/deep", "/skip_dir"]
    assert rows["/link"].symlink_target == "root_file.txt" and rows["/link"].size == 0
    assert rows["/hard.txt"].id == rows["/root_file.txt"].id and rows["/hard.txt"].links == 2
    assert "/.hidden" not in rows
    assert "/.hidden" in {r.path for r in _load(spark, tree, scan_hidden="true").collect()}


def test_tree_filters(spark, tree):
    files = lambda **o: sorted(r.path for r in _load(spark, tree, **o).filter("kind = 'file'").collect())
    assert files(exclude_dirs="skip_dir", exclude_files="*.txt") == ["/keep_dir/a.txt", "/keep_dir/deep/b.csv"]
    assert files(include_files="/*/*.txt") == ["/keep_dir/a.txt", "/skip_dir/c.txt"]
    assert files(max_depth="1") == ["/hard.txt", "/keep_dir/a.txt", "/root_file.txt", "/skip_dir/c.txt"]
    assert _load(spark, tree, follow_symlinks="true").count() > 0  # a loop of links ends


def _copy_file(kind, diff, name, a, b, count=None):
    raw = name.encode()
    if kind == "FILE":
        return codec.frame(struct.pack("<BBHIII", 2, diff, 0, a, b, len(raw)) + raw)
    return codec.frame(struct.pack("<BBHIIIIII", 1, diff, 0, a, b, count, 0, 0, len(raw)) + raw)


def test_control_files(spark, tmp_path):
    head = lambda word: codec.write_header(f"#X_{word}_CTRL_FILE", {"COUNT": 1})
    copies = head("BACKUP") + _copy_file("DIR", 2, " /tmp/source\n dir", 1, 2, 5) + _copy_file("FILE", 1, " leading\nfile.txt", 3, 4)
    (tmp_path / "copy_1.control.bin").write_bytes(copies)
    raw = " weird\npath".encode()
    (tmp_path / "delete_1.control.bin").write_bytes(head("DELETE") + codec.frame(struct.pack("<BBBBI", 2, 0, 0, 0, len(raw)) + raw))
    (tmp_path / "mtime_1.control.bin").write_bytes(head("MTIME") + codec.frame(struct.pack("<IIIIQQ", 0o755, 0, 0, 2, 7, 8) + b"/a"))
    linked = codec.frame(struct.pack("<BBBBQQI", 1, 0, 0, 0, (1 << 64) - 1, 5, 2)) + codec.frame(struct.pack("<BBBBIII", 2, 0, 0, 0, 1, 2, 2) + b"/a")
    (tmp_path / "hardlink_1.control.bin").write_bytes(head("HARDLINK") + linked)
    (tmp_path / "fcache_0.dat").write_bytes(struct.pack("<QIII", 9, 8, 7, 6) * 2)
    spark.dataSource.register(codec.ControlFile)
    read = lambda kind: spark.read.format("control").option("kind", kind).load(str(tmp_path)).orderBy(1).collect()
    assert [(r.kind, r.diff, r.path, r.files_count) for r in read("copy")] == [("DIR", "MetaModified", " /tmp/source\n dir", 5), ("FILE", "New", " leading\nfile.txt", None)]
    assert [(r.entry_type, r.path) for r in read("delete")] == [("File", " weird\npath")]
    assert [(r.path, r.mode, r.mtime) for r in read("mtime")] == [("/a", 0o755, 8)]
    assert [(r.kind, r.inode) for r in read("hardlink")] == [("INODE", -1), ("FILE", None)]
    assert [(r.idx, r.id, r.meta_offset) for r in read("fcache")] == [(0, 9, 6), (1, 9, 6)]
    assert codec.detect("copy_1.control.bin", len(copies), copies[:64]) == "copy"
    with pytest.raises(ValueError):
        list(codec.frames(copies[:-3]))
    assert list(codec.frames(head("DELETE"))) == []


_META = {
    "kind": "File", "id": -2, "mode": 0o100644, "attr": 0, "atime": 1, "ctime": 2, "mtime": 3, "devno": 7, "name": "ü.txt", "security_descriptor": None,
    "posix_access_acl": "user::rw-", "posix_default_acl": None, "symlink_target_path": None, "xattributes": '{"a":"b"}', "size": 5, "links": 1,
    "sparse": [{"off": 0, "len": 4}], "path": None,
}


def test_metadata_layout():
    """The fixed layout byte by byte, and there and back."""
    raw = codec.encode_meta(_META)
    name = "ü.txt".encode()
    want = struct.pack("<QIIIIIQ", (1 << 64) - 2, 0o100644, 0, 1, 2, 3, 7) + struct.pack("<Q", len(name)) + name + b"\0"
    want += b"\1" + struct.pack("<Q", 9) + b"user::rw-" + b"\0\0" + b"\1" + struct.pack("<Q", 9) + b'{"a":"b"}'
    want += struct.pack("<QQBQQQ", 5, 1, 1, 1, 0, 4)
    assert raw == struct.pack("<BI", 2, len(want)) + want
    folder = _META | {"kind": "Dir", "path": "/x", "size": None, "links": None, "sparse": None}
    rows = list(codec.decode("meta", raw + codec.encode_meta(folder), "meta_3_2.dat"))
    assert [r[:4] for r in rows] == [(0, 3 << 16 | 2, 0, "File"), (1, 3 << 16 | 2, len(raw), "Dir")]
    assert list(rows[0][4:-1]) == list(_META.values())[1:] and list(rows[1][4:-1]) == list(folder.values())[1:]
    with pytest.raises(ValueError):
        list(codec.decode("meta", raw[:-1], "meta_0_0.dat"))


def test_metadata_sizes(spark):
    schema = codec.SCHEMAS["meta"]
    rows = [_META, _META | {"sparse": None, "xattributes": None}, _META | {"kind": "Dir", "path": "/é", "sparse": None, "size": None, "links": None}]
    made = spark.createDataFrame([(i, 0, 0, *r.values(), "meta_0_0.dat") for i, r in enumerate(rows)], schema)
    optional = [F.col(c) for c in codec._OPTIONAL]
    size = codec.meta_size(F.col("name"), F.col("path"), F.col("kind") == "Dir", *optional, ranges=F.size("sparse").cast("long"))
    size = F.when(F.col("sparse").isNull(), codec.meta_size(F.col("name"), F.col("path"), F.col("kind") == "Dir", *optional)).otherwise(size)
    assert [r[0] for r in made.orderBy("seq").select(size).collect()] == [len(codec.encode_meta(r)) for r in rows]


@pytest.mark.parametrize("kind", list(codec.SCHEMAS))
def test_written_files_read_back(spark, tmp_path, kind):
    text = "weird\npath ü"
    rows = {
        "copy": [(0, "DIR", "New", text, 1, 2, 1, 2, 0, 1), (1, "FILE", "DataModified", "f", 3, 4, None, 0, None, None)],
        "delete": [(0, "File", text), (1, "Dir", "/a")],
        "mtime": [(0, text, 0o755, 1, 2, 7, 8)],
        "hardlink": [(0, "INODE", -1, 5, 2, None, None, None), (1, "FILE", None, None, None, 1, 2, text)],
        "dcache": [(0, -1, 1, 2, 3, 4, 5, 6), (1, 2, 1, 2, 3, 4, 5, 6)],
        "fcache": [(0, -1, 1, 2, 3)],
        "meta": [(0, 1 << 16, 0, *_META.values())],
        "blobindex": [(0, text, "/blob_1", 1, 2, 3, 4, None, "acl"), (1, "b", "/blob_2", 5, 6, 7, 8, "x", None)],
    }[kind]
    files = [{"meta": "meta_1_0.dat", "blobindex": "b1/I.bidx"}.get(kind, f"{kind}_{k}.control.bin") for k in (0, 1)]
    made = spark.createDataFrame([(*r, f) for f in dict.fromkeys(files) for r in rows], codec.SCHEMAS[kind])
    for _ in range(2):  # a second write takes the first one's place
        codec.write(made, kind, str(tmp_path / "out"), source_root='"/"', time=0)
    assert sorted(codec.read(spark, kind, str(tmp_path / "out")).collect(), key=repr) == sorted(made.collect(), key=repr)
    assert not [n for n in os.listdir(tmp_path / "out") if n.endswith(".part")]
    if kind == "copy":
        _, settings = codec.read_header((tmp_path / "out" / files[0]).read_bytes())
        assert (settings["FILE_COUNT"], settings["DIR_COUNT"], settings["RECORD_COUNT"], settings["SOURCE_ROOT"]) == ("1", "1", "2", '"/"')


def test_manifest_defaults(spark):
    rows = spark.createDataFrame([(1, '{"version":"1.0"}'), (2, '{"aggregation":{"layout":"dir","shard_count":3}}')], "id int, json string")
    got = {r.id: r.m for r in manifest.read_manifest(rows, "json").collect()}
    assert got[1].aggregation.max_blob_size == 64 << 20 and got[2].aggregation.layout == "dir"


def test_fileset(spark):
    rows = fileset.generate(spark, 3, 2, 4, 100)
    assert rows.count() == 4 * (1 + 2 + 4) and rows.select("path").distinct().count() == 28
    one = fileset.estimate(spark.createDataFrame([("x", 3, 2, 4, 100)], "name string, depth int, dirs long, files long, size long")).first()
    assert (one.n_files, one.n_dirs, one.bytes) == (28, 14, 2800)


def test_incremental_state(spark, tmp_path):
    schema = "k long, n long, v string"
    for i, part in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")], [(1, 2, "d"), (3, 1, "e")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, maxFilesPerTrigger="1")
        ingest.fold_last(stream, ["k"], "n", str(tmp_path / "state"), str(tmp_path / "checkpoint"))
    state = {r.k: (r.n, r.v) for r in ingest.read_state(spark, str(tmp_path / "state"), ["k"], "n").collect()}
    assert state == {1: (2, "d"), 2: (1, "b"), 3: (1, "e")}


def test_windows(spark):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts FROM range(4)")
    n = {"n": F.count(F.lit(1))}
    assert [r.n for r in ingest.tumbling(rows, "ts", "1 hour", aggregates=n).collect()] in ([3, 1], [1, 3])
    assert ingest.sessions(rows, "ts", "30 minutes", aggregates=n).count() == 1


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (2, "c", 5)], "dir_id long, name string, size long")
    dirs = spark.createDataFrame([(1, "/x"), (2, "/y")], "dir_id long, path string")
    for snapshot in ("s1", "s2", "s1"):
        sinks.write_catalog(files, dirs, str(tmp_path / "catalog"), snapshot)
    assert sinks.read_snapshot(spark, str(tmp_path / "catalog"), "files", "s1").count() == 3
    plan = spark.createDataFrame([("DIR", "/x", None), ("FILE", "/x", "a"), ("DIR", "/y", None)], "kind string, dir_path string, name string")
    header = sinks.write_plan(plan, str(tmp_path / "plan"), 4).collect()
    assert (sum(r.dirs for r in header), sum(r.files for r in header)) == (2, 1)
    sinks.rewrite_plan(spark, str(tmp_path / "plan"), str(tmp_path / "plan2"), "dir_path", lambda c: F.concat(F.lit("/r"), c))
    assert {r.dir_path for r in spark.read.parquet(str(tmp_path / "plan2")).collect()} == {"/r/x", "/r/y"}
    index = spark.createDataFrame([("/x", "a", 1, 5), ("/x", "a", 2, 6), ("/y", "a", 1, 7)], "dir string, name string, seq long, offset long")
    sinks.write_dir_index(index, str(tmp_path / "index"))
    assert [r.offset for r in sinks.lookup_dir_index(spark, str(tmp_path / "index"), "/x", "a").collect()] == [6]


def test_blobs(spark):
    rows = spark.createDataFrame([("b", 0, 3, b"de"), ("b", 0, 0, b"abc"), ("b", 1, 0, b"f")], "bucket string, blob long, offset long, content binary")
    blobs = sinks.blob_contents(rows)
    assert {(r.blob, bytes(r.content)) for r in blobs.collect()} == {(0, b"abcde"), (1, b"f")}
    index = spark.createDataFrame([("b", 0, 3, 2), ("b", 1, 0, 9), ("b", 7, 0, 1)], "bucket string, blob long, offset long, size long")
    got = {r.blob: (r.out_of_range, r.content and bytes(r.content)) for r in sinks.read_from_blobs(index, blobs).collect()}
    assert got == {0: (False, b"de"), 1: (True, None), 7: (True, None)}
