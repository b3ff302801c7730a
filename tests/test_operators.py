"""Filters, diffs, packing, links, restore rules, plans."""

import random

import pytest
from pyspark.sql import functions as F

from lithos.operators import diff, failures, links, packing, ranking, report, restore, tasks
from lithos.operators.filters import PathFilter, segment_matches, should_aggregate, suppressed, visible
from lithos.plans import control


def flags(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select(make(F.col("v")), "i").orderBy("i").collect()]


def test_segment_patterns(spark):
    check = lambda pattern, words: flags(spark, words, lambda c: segment_matches(c, pattern))
    assert check("*.txt", ["a.txt", "a.txt.bak"]) == [True, False]
    assert check("a", ["a", "aba", "ab"]) == [True, True, False]
    assert check("ab", ["abab", "ab", "abc"]) == [True, True, False]
    assert check("*", ["", "x"]) == [True, True]
    assert check("a*b", ["ab", "axb", "a\nb", "ba"]) == [True, True, True, False]


def test_filter_vectors(spark):
    f = PathFilter(include_dirs=["/dir/*/*/dir1"])
    assert flags(spark, ["/", "/dir", "/dir/a", "/dir/a/b", "/dir/a/b/dir1", "/dir/a/b/dir1/x"], f.descend_dir) == [True] * 6
    f = PathFilter(include_files=["/dir/*/dir1/*.txt"], exclude_files=["/dir/*/dir1/1.txt"])
    assert flags(spark, [f"/dir/a/dir1/{n}" for n in ("2.txt", "1.txt", "2.log")], f.emit_file) == [True, False, False]
    f = PathFilter(include_dirs=["/dir/*/dir1"], exclude_dirs=["/dir/*/dir1/dir1"])
    assert flags(spark, ["/dir/a/dir1", "/dir/a/dir1/dir1"], f.descend_dir) == [True, False]
    assert flags(spark, ["/dir/a/dir1/dir1/x"], f.emit_dir) == [False]
    assert flags(spark, ["/a", "/"], PathFilter().emit_file) == [True, True]
    with pytest.raises(ValueError):
        PathFilter(include_dirs=[" "])


def test_small_predicates(spark):
    assert flags(spark, [".x", "x", "..", "skip"], lambda c: visible(c, skip_names=["skip"])) == [False, True, False, False]
    sizes = spark.createDataFrame([(100,), (1048575,), (1048576,), (0,)], "n long")
    assert [r[0] for r in sizes.select(should_aggregate(F.col("n"), 1 << 20)).collect()] == [True, True, False, False]
    text = "Error closing file: Network Name Deleted (0xc00000c9)"
    assert flags(spark, [text, "other"], lambda c: suppressed(F.lit("smb::resource"), c)) == [True, False]


def test_id_diff(spark):
    ids = lambda n: spark.createDataFrame([(k,) for k in n], "id long")
    before, after = set(range(-5, 40, 3)), set(range(-7, 30, 2))
    found = {tuple(r) for r in diff.diff_ids(ids(before), ids(after)).collect()}
    assert found == {(k, "Deleted") for k in before - after} | {(k, "New") for k in after - before}


def test_rename_is_a_change_of_the_directory_only(spark):
    dirs = lambda path, h: spark.createDataFrame([(1, path, h)], "dir_id long, path string, hash long")
    files = spark.createDataFrame([(1, "a", 5, 1, 1)], "dir_id long, name string, hash long, size long, mtime long")
    plan = diff.copy_plan(dirs("/old", 1), dirs("/new", 2), files, files).collect()
    assert [(r.kind, r.dir_path, r.diff) for r in plan] == [("DIR", "/new", "MetaModified")]
    assert diff.delete_plan(dirs("/old", 1), dirs("/new", 2), files, files).count() == 0


def test_empty_previous_snapshot_makes_everything_new(spark):
    dirs = spark.createDataFrame([(1, "/a", 1)], "dir_id long, path string, hash long")
    files = spark.createDataFrame([(1, "f", 5, 1, 1)], "dir_id long, name string, hash long, size long, mtime long")
    plan = diff.copy_plan(dirs.limit(0), dirs, files.limit(0), files).collect()
    assert sorted((r.kind, r.diff) for r in plan) == [("DIR", "New"), ("FILE", "New")]


def test_greedy_packing(spark):
    rows = spark.createDataFrame([("b", 1, 50), ("b", 2, 60), ("b", 3, 10), ("c", 1, 100), ("c", 2, 1), (None, 1, 5)], "bucket string, id long, size long")
    found = packing.pack_greedy(rows, "bucket", ["id"], "size", 100).collect()
    got = {(r.bucket, r.id): (r.blob, r.offset) for r in found}
    assert got == {("b", 1): (0, 0), ("b", 2): (0, 50), ("b", 3): (1, 0), ("c", 1): (0, 0), ("c", 2): (1, 0), (None, 1): (0, 0)}


def test_batches(spark):
    rows = spark.createDataFrame([(1, 500), (2, 2500), (3, 0)], "id long, n long")
    found = packing.split_batches(rows, "n", 1000).orderBy("id", "batch").collect()
    assert [(r.id, r.files, r.is_continuation, r.is_last) for r in found] == [
        (1, 500, False, True), (2, 1000, False, False), (2, 1000, True, False), (2, 500, True, True), (3, 0, False, True),
    ]


def test_prefix_sum(spark):
    rows = spark.range(0, 300).select("id", (F.col("id") % 7).alias("v"))
    found = {r.id: r.total for r in packing.prefix_sum(rows, "id", "v", "total", block=16).collect()}
    total = 0
    for i in range(300):
        total += i % 7
        assert found[i] == total


def test_hardlinks(spark):
    rows = spark.createDataFrame([(k, 70 + k // 3, 9, 3, f"/n{k}") for k in range(6)] + [(7, 80, 9, 1, "/alone")], "seq long, id long, devno long, links long, path string")
    groups = sorted(tuple(r) for r in links.restore_groups(rows).collect())
    assert groups == [(70, 9, 3, ["/n0", "/n1", "/n2"]), (71, 9, 3, ["/n3", "/n4", "/n5"])]
    actions = links.link_actions(rows, ["id", "devno"], usable=~F.col("path").isin("/n0", "/n4")).orderBy("seq").collect()
    assert [(r.path, r.action, r.primary_path) for r in actions] == [("/n1", "primary", "/n1"), ("/n2", "link", "/n1"), ("/n3", "primary", "/n3"), ("/n5", "link", "/n3")]


def test_restore_policy(spark):
    rows = spark.createDataFrame([(5, True, 4), (4, True, 4), (None, True, 4), (5, True, None), (None, False, None), (None, True, None)], "s long, e boolean, t long")
    got = [r[0] for r in rows.select(restore.should_restore(F.lit("keep_newer"), F.col("s"), F.col("e"), F.col("t"))).collect()]
    assert got == [True, False, False, True, True, True]
    got = [r[0] for r in rows.select(restore.should_restore(F.lit("skip"), F.col("s"), F.col("e"), F.col("t"))).collect()]
    assert got == [False, False, False, False, True, False]


def test_requests(spark):
    files = spark.createDataFrame([("/d1/f1", "/d1"), ("/d10/f1", "/d10"), ("/d2/x/f", "/d2/x")], "path string, dir string")
    dirs = spark.createDataFrame([("/",), ("/d1",), ("/d10",), ("/d2",), ("/d2/x",)], "path string")
    d, f = spark.createDataFrame([("/d1",)], "path string"), spark.createDataFrame([("/d2/x/f",)], "path string")
    named = d.select("path", F.lit("dir").alias("kind")).unionByName(f.select("path", F.lit("file").alias("kind")))
    found = control.fine_grain(named, dirs, files).collect()
    assert sorted(r.path for r in found if r.kind == "FILE") == ["/d1/f1", "/d2/x/f"]
    assert sorted(r.path for r in found if r.kind == "DIR") == ["/", "/d1", "/d2", "/d2/x"]
    assert control.fine_grain(named.filter("false"), dirs, files).count() == 0
    asked = spark.createDataFrame([("d1", "/d1"), ("gone", "/gone")], "raw string, path string")
    assert [r.raw for r in control.unresolved(asked, dirs, files).collect()] == ["gone"]


def test_peak_concurrency(spark):
    rows = spark.createDataFrame([("k", 0, 10), ("k", 5, 8), ("k", 8, 9), ("j", 1, 2)], "k string, a long, b long")
    assert {r.k: r.peak for r in report.peak_concurrency(rows, "k", "a", "b").collect()} == {"k": 2, "j": 1}


def test_tasks(spark):
    rows = spark.createDataFrame(
        [("t", "scan", 1, "create"), ("t", "scan", 2, "exit_ok"), ("t", "scan", 3, "kill"), ("u", "backup", 1, "start")], "task string, kind string, seq long, event string"
    )
    states = tasks.states(rows, "task", "seq")
    assert {r.task: r.state for r in states.collect()} == {"t": "completed", "u": "starting"}
    assert {r.pool: (r.active, r.refused) for r in tasks.active_by_kind(states, {"scan": 1, "subtask": 1}).collect()} == {"scan": (0, False), "subtask": (1, True)}


def test_failure_files(spark, tmp_path):
    rows = spark.createDataFrame([("t", "copy", "write", "file", "/a&b", "EIO", "<x>", 2)], failures.COLUMNS)
    for fmt in ("csv", "json", "xml"):
        failures.write(rows, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().path == "/a&b"
    assert spark.read.format("xml").option("rowTag", "failure").load(str(tmp_path / "xml")).first().detail == "<x>"
    assert spark.read.json(str(tmp_path / "json")).first().attempts == 2


def _by_rows(sizes, step):
    state, out = [0, 0, 0], []
    for n in sizes:
        out.append(step(state, n or 0))
    return out


def _packed(state, n, most=10):
    out = state[0], state[1]
    state[1] += n
    if state[1] >= most:
        state[:2] = state[0] + 1, 0
    return out


def _rolled(state, n, most=10, entries=4):
    if state[1] >= most or state[2] >= entries:
        state[:] = state[0] + 1, 0, 0
    out = state[0], state[2]
    state[1:] = state[1] + n, state[2] + 1
    return out


def _segmented(state, n, most=10):
    if state[1] + n > most:
        state[:2] = state[0] + 1, 0
    out = state[0], state[1]
    state[1] += n
    return out


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_bins_equal_a_fold_by_rows(spark, batch):
    """Null sizes count as 0; bins go on over batches and end with their bucket."""
    rng = random.Random(5)
    rows = [(b, i, rng.choice([None, 0, 1, 3, 9, 10, 25])) for b in ("x", "y", None) for i in range(60)]
    df = spark.createDataFrame(rows, "b string, i long, n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for out, step, names in (
            (packing.pack_greedy(df, "b", ["i"], "n", 10), _packed, ("blob", "offset")),
            (packing.roll_over(df, "b", ["i"], "n", 10, 4), _rolled, ("file_index", "entry")),
            (packing.segment_rollover(df, "b", ["i"], "n", 10), _segmented, ("segment", "offset")),
        ):
            found = {(r.b, r.i): (r[names[0]], r[names[1]]) for r in out.collect()}
            for b in ("x", "y", None):
                want = _by_rows([n for k, _, n in rows if k == b], step)
                assert [found[b, i] for i in range(60)] == want
            assert out.filter("false").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_two_level_windows(spark, block):
    rng = random.Random(block)
    rows = [(p, i, rng.choice([None, 0, 4, 9]), rng.choice([None, "a", "b"])) for p in ("x", None) for i in rng.sample(range(-50, 50), 40)]
    df = spark.createDataFrame(rows, "p string, i long, n long, v string")
    sums = {(r.p, r.i): r.s for r in ranking.running_sum(df, "p", "i", "n", "s", block).collect()}
    numbers = {(r.p, r.i): r.k for r in ranking.row_numbers(df, "p", "i", "k", block).collect()}
    filled = {(r.p, r.i): r.f for r in ranking.fill_forward(df, "p", "i", F.col("v"), "f", block).collect()}
    for p in ("x", None):
        total, last = 0, None
        for k, (_, i, n, v) in enumerate(sorted((r for r in rows if r[0] == p), key=lambda r: r[1])):
            last = v or last
            assert (sums[p, i], numbers[p, i], filled[p, i]) == (total, k, last)
            total += n or 0
    assert ranking.running_sum(df.filter("false"), "p", "i", "n", "s").count() == 0


def test_ranks_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), f"{rng.randrange(500):03d}") for _ in range(400)]
    found = ranking.ranks(spark.createDataFrame(rows, "k string, t string"), ["k"], F.col("t").desc(), "rank").collect()
    for k in ("a", "b", None):
        own = sorted((r["rank"], r.t) for r in found if r.k == k)
        assert [n for n, _ in own] == list(range(1, len(own) + 1))
        assert [t for _, t in own] == sorted((t for key, t in rows if key == k), reverse=True)
