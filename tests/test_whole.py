"""Queries take every row of their tables."""

from lithos import catalog, queries

queries.load()


def test_segment_rollover_of_every_file(spark, sf):
    """Every file, against a plain fold."""
    got = {r.id: (r.shard, r.segment, r.offset) for r in queries.QUERIES["segment_rollover"](spark, sf).collect()}
    at, want = {}, {}
    for r in catalog.files(spark, sf).orderBy("id").collect():
        shard, size = r.line % 4, r.size + 60
        segment, used = at.get(shard, (0, 0))
        if used and used + size > 300_000:
            segment, used = segment + 1, 0
        want[r.id] = (shard, segment, used)
        at[shard] = (segment, used + size)
    assert got == want


def test_segments_beyond_16_bits(spark):
    """The file id of shard * 65536 + segment, also where a writer has more segments than that."""
    from lithos.queries import packing

    files = spark.range(70_000).selectExpr("id", "1L AS line", "250000L AS size").unionByName(spark.createDataFrame([(-1, 1, 400_000)], "id long, line long, size long"))
    rows = packing._segments(files)
    assert rows.filter("file_id <> shard * 65536 + segment").count() == 0
    assert rows.agg({"segment": "max"}).first()[0] == 70_000
    first = rows.filter("id = -1").first()
    assert (first.segment, first.offset, first.file_id) == (0, 0, 65536)


def test_tasks_of_every_event(spark, sf):
    events = catalog.table(spark, sf, "events")
    rows = queries.QUERIES["task_state_machine"](spark, sf).collect()
    assert sum(r.events for r in rows) == events.count()
    assert {r.task for r in rows} == {r.user_id for r in events.select("user_id").distinct().collect()}
    assert sum(r.tasks for r in queries.QUERIES["task_limits"](spark, sf).collect()) == len(rows)


def test_reports_of_every_order(spark, sf):
    orders = catalog.table(spark, sf, "orders").count()
    found = {(r.kind, r.type): r.n for r in queries.QUERIES["inspect_union"](spark, sf).collect()}
    assert found["metadata", "dir"] == orders
    assert queries.QUERIES["union_by_name"](spark, sf).filter("kind = 'metadata'").count() == orders


def test_depth_limit_of_every_page(spark, sf):
    want = {r.id for r in catalog.urls(spark, sf).collect() if len([x for x in r.path.split("/") if x]) <= 3}
    assert {r.id for r in queries.QUERIES["depth_limit"](spark, sf).collect()} == want
    assert any(i % 2 for i in want)
