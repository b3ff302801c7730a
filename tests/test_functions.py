"""Vectors of paths, hashes and scalar functions."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithos.functions import hashing, paths, scalars


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column).first()[0]


def each(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select(make(F.col("v")), "i").orderBy("i").collect()]


def test_normalize(spark):
    raw = ["//srv///www/", "srv/www", "/srv/x/.././log.1", "Q:\\run\\me", "./", "", "../..", "k/../../m"]
    assert each(spark, raw, paths.normalize) == ["/srv/www", "/srv/www", "/srv/log.1", "/Q:/run/me", "/", "/", "/", "/m"]


def _model(raw):
    out = []
    for part in raw.replace("\\", "/").split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab./\\", max_size=12), min_size=40, max_size=40))
def test_normalize_equals_model(spark, raw):
    assert each(spark, raw, paths.normalize) == list(map(_model, raw))


def test_join_and_pieces(spark):
    joined = [one(spark, paths.join(F.lit(base), F.lit("log.1"))) for base in ("/srv/www", "/", "/srv/www/")]
    assert joined == ["/srv/www/log.1", "/log.1", "/srv/www/log.1"]
    assert each(spark, ["log.1", "/srv/log.1", "/srv"], paths.is_root_entry) == [True, False, True]
    assert each(spark, ["/D/x/y", "/ab/c", "/D"], paths.logical_to_native) == ["D:/x/y", "ab/c", "D"]
    assert each(spark, ["a/b/c", "a", "/a"], paths.parent) == ["a/b", "", ""]
    assert one(spark, paths.ancestors(F.lit("/a/b/c"))) == ["/", "/a", "/a/b", "/a/b/c"]
    assert one(spark, paths.ancestors(F.lit("/"))) == ["/"]


def test_prefix(spark):
    hits = [one(spark, paths.starts_with_path(F.lit("/srv"), F.lit(p))) for p in ("/srv/www", "/srvx", "/srv", "/sr")]
    assert hits == [True, False, True, False]
    assert one(spark, paths.starts_with_path(F.lit("/"), F.lit("/x")))


def test_mappings(spark):
    target = lambda p, logical, source: one(spark, paths.to_target(F.lit(p), source, "/mnt/copy", logical))
    assert target("/www/log.1", True, "/srv") == "/mnt/copy/www/log.1"
    assert target("/srv/www/log.1", False, "/srv/www") == "/mnt/copy/log.1"
    assert target("/var/log.1", False, "/srv/www") == "/mnt/copy/var/log.1"
    asked = lambda p: one(spark, paths.requested_to_logical(F.lit(p), "/srv/pool", "/vol"))
    assert (asked("/k/m.txt"), asked("/srv/pool/vol/k")) == ("/vol/k/m.txt", "/vol/k")
    layout = lambda name, prefix: one(spark, paths.layout_path(F.lit("/ds2/a/b"), name, prefix, "/ds2"))
    assert layout("remote_source", "") == "a/b"
    assert layout("prefixed_remote_relative_target", "copies/7") == "copies/7/a/b"
    assert layout("prefixed_logical_target", "P") == "P/ds2/a/b"
    with pytest.raises(ValueError):
        paths.layout_path(F.lit("/a"), "other", "", "/")


def test_locations(spark):
    nfs = one(spark, paths.nfs_location(F.lit("nfs://store.example.org/pool/seven?sub=one/two&uid=501&gid=20")))
    assert tuple(nfs) == ("store.example.org", None, "/pool/seven", "one/two", 501, 20)
    assert one(spark, paths.nfs_location(F.lit("nfs://h/"))) is None
    smb = one(spark, paths.smb_location(F.lit("smb:\\\\h:445\\share\\a\\b?username=u&password=p")))
    assert tuple(smb) == ("h", 445, "share", "a/b", "u", True)
    assert each(spark, ["nfs://h/e", "smb://h/s", "/x"], paths.location_kind) == ["NFS", "SMB", "Local"]
    specs = ["nfs://h:1/e?sub=/a&uid=1", "smb://h/s/t?username=u&password=p", "/x"]
    assert each(spark, specs, paths.display_location) == ["nfs://h/e/a", "smb://h/s/t", "/x"]
    assert one(spark, scalars.rfc3339(F.lit("2024-01-31 12:00:00").cast("timestamp"))) == "2024-01-31T12:00:00Z"


def _fnv(text, basis):
    h = basis
    for b in text.encode():
        h = (h ^ b) * hashing.PRIME % (1 << 64)
    return h


def test_shards(spark):
    names = ["/home/user/documents", "/", "/a/b/c", "", "/ü/漢"]
    assert each(spark, names, lambda c: hashing.plan_shard(c, 16))[:3] == [8, 14, 14]
    assert each(spark, names, lambda c: hashing.blob_shard(c, 16))[:3] == [6, 4, 8]
    for n in (7, 1000, (1 << 31) - 1):
        assert each(spark, names, lambda c, n=n: hashing.plan_shard(c, n)) == [_fnv(x, hashing.PLAN_BASIS) % n for x in names]


def test_hashes(spark):
    digest = hashlib.sha256(b"x").digest()
    assert one(spark, hashing.hash32(F.lit("x"))) == int.from_bytes(digest[:4], "little")
    assert one(spark, hashing.control_kind(F.lit("copy_0.control.bin"))) == "copy"
    assert one(spark, hashing.control_kind(F.lit("copy_0.bin"))) is None
    assert one(spark, hashing.control_name(F.lit("copy"), F.lit("main"))) == f"copy_{hashlib.sha256(b'copy:main').hexdigest()[:16]}.control.bin"
    packed = one(spark, hashing.pack_locator(F.lit(3), F.lit(7)))
    assert (packed, packed >> 16, packed & 0xFFFF) == (3 << 16 | 7, 3, 7)


def test_retry_delays(spark):
    policy = scalars.RetryPolicy(5, 100.0, 2.0, 250.0)
    assert [one(spark, policy.delay(F.lit(k))) for k in (1, 2, 3, 4)] == [100, 200, 250, 250]
    assert 75 <= one(spark, scalars.RetryPolicy(5, 100.0, 2.0, 250.0, 0.25).delay(F.lit(1))) <= 125


def test_errors(spark):
    texts = ["os: EACCES", "Permission denied", "x", "enoent and eperm", "Network Name Deleted"]
    assert each(spark, texts, scalars.classify_error) == ["EACCES", "PERMISSION_DENIED", "UNKNOWN", "EPERM", "NETWORK_NAME_DELETED"]
    assert [one(spark, scalars.classify_errno(F.lit(n))) for n in (13, 999)] == ["EACCES", "ERRNO_999"]


def test_sizes(spark):
    texts = ["1.5K", "10", "2 mb", "1T", "x", "", "1.2.3K", "5Q"]
    assert each(spark, texts, scalars.parse_size) == [1536, 10, 2 << 20, 1 << 40, None, None, None, None]
    assert [one(spark, scalars.format_bytes(F.lit(n))) for n in (0, 1023, 1024, 1 << 20, 3 << 30)] == ["0 B", "1023 B", "1.00 KiB", "1.00 MiB", "3.00 GiB"]
    assert [one(spark, scalars.format_duration(F.lit(n))) for n in (999, 61_005)] == ["0.999s", "1m 1.005s"]
    assert one(spark, scalars.filetime_to_unix(F.lit(0).cast("long"))) == 0
    assert one(spark, scalars.filetime_to_unix(F.lit(116444736010000000))) == 1
    assert one(spark, scalars.synthesize_mode(F.lit(True), F.lit(True))) == 0o040555
    assert one(spark, scalars.pairs_to_map(F.lit("a=eA==\nb=eT1="))) is not None
