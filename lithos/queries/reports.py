"""Queries over failures, retries, statistics, inspection and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos import catalog
from lithos.catalog import with_views
from lithos.functions import scalars
from lithos.operators import failures, report, tasks
from lithos.queries import query

_TEXTS = """, t AS (SELECT id, CASE id % 8 WHEN 0 THEN 'io error: eacces on ' || path WHEN 1 THEN 'Permission denied: ' || path WHEN 2 THEN 'NFS3ERR_JUKEBOX' WHEN 3 THEN 'no such file ' || name
    WHEN 4 THEN 'Network Name Deleted (0xc00000c9)' WHEN 5 THEN 'no space left' WHEN 6 THEN 'plain text' ELSE 'ETIMEDOUT after ENOENT' END AS detail FROM vdocs)"""
_TOKENS = " ".join(f"WHEN contains(upper(detail), '{t}') THEN '{t.replace(' ', '_')}'" for t in scalars.ERROR_TOKENS)
_NUMBERS = " ".join(f"WHEN {n} THEN '{name}'" for n, name in scalars.ERROR_NUMBERS.items())


@query(with_views(
    f"""{_TEXTS} SELECT id, detail, CASE {_TOKENS} ELSE 'UNKNOWN' END AS code,
    CASE id % 120 {_NUMBERS} ELSE 'ERRNO_' || id % 120 END AS errno FROM t""", "vdocs"))  # fmt: skip
def error_classify(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id")
    texts = (
        F.concat(F.lit("io error: eacces on "), "path"), F.concat(F.lit("Permission denied: "), "path"), F.lit("NFS3ERR_JUKEBOX"), F.concat(F.lit("no such file "), "name"),
        F.lit("Network Name Deleted (0xc00000c9)"), F.lit("no space left"), F.lit("plain text"), F.lit("ETIMEDOUT after ENOENT"),
    )
    rows = catalog.docs(spark, sf).select("id", F.get(F.array(*texts), (n % 8).cast("int")).alias("detail"))
    return rows.select("id", "detail", scalars.classify_error(F.col("detail")).alias("code"), scalars.classify_errno(n % 120).alias("errno"))


_POLICIES = {
    "fixed": scalars.RetryPolicy(3, 1000.0, 1.0, 1000.0, 0.0),
    "backoff": scalars.RetryPolicy(5, 100.0, 2.0, 250.0, 0.0),
    "jitter": scalars.RetryPolicy(4, 100.0, 1.5, 10_000.0, 0.25),
    "once": scalars.RetryPolicy(0, 50.0),
}


@query("""
    WITH p(policy, retries, delay, mult, most, jitter) AS (VALUES ('fixed', 3, 1000.0, 1.0, 1000.0, 0.0), ('backoff', 5, 100.0, 2.0, 250.0, 0.0),
        ('jitter', 4, 100.0, 1.5, 10000.0, 0.25), ('once', 0, 50.0, 1.0, 1000.0, 0.0)),
    a AS (SELECT *, unnest(range(1, retries + 2)) AS attempt FROM p)
    SELECT policy, attempt::BIGINT AS attempt, attempt <= retries AS retried, CASE WHEN attempt <= retries THEN
        round((least(delay::DOUBLE * pow(mult::DOUBLE, attempt - 1), greatest(most, delay)::DOUBLE)
        * (1 + (((attempt::BIGINT * 1103515245 + 12345) % 4294967296) % 10000 / 10000.0::DOUBLE * 2 - 1) * jitter::DOUBLE)) * 1000)::BIGINT END AS delay_us FROM a""")
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    rows = failures.schedule(spark, _POLICIES)
    return rows.select("policy", "attempt", "retried", F.round(F.col("delay_ms") * 1000).cast("long").alias("delay_us"))


_FAILURES = """WITH f AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'hardlink' WHEN 2 THEN 'delete' ELSE 'mtime' END AS phase,
    CASE event_id % 3 WHEN 0 THEN 'EACCES' WHEN 1 THEN 'ENOENT' ELSE 'UNKNOWN' END AS code, (event_id % 4 + 1)::BIGINT AS attempts,
    epoch(date_trunc('second', ts))::BIGINT AS time FROM events WHERE event_type = 'error')"""


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    detail = F.get(F.array(F.lit("os error EACCES"), F.lit("enoent"), F.lit("?")), (n % 3).cast("int"))
    phase = F.get(F.array(*map(F.lit, ("copy", "hardlink", "delete", "mtime"))), (F.col("user_id") % 4).cast("int"))
    return catalog.table(spark, sf, "events").filter("event_type = 'error'").select(
        n, catalog.epoch(F.date_trunc("second", "ts")).alias("time"), phase.alias("phase"), F.lit("write").alias("operation"), F.lit("file").alias("item_type"),
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), scalars.classify_error(detail).alias("code"), detail.alias("detail"),
        (n % 4 + 1).alias("attempts"),
    )


@query(_FAILURES + """ SELECT phase, code, count(*)::BIGINT AS items, sum(attempts)::BIGINT AS attempts, min(time)::BIGINT AS first, max(time)::BIGINT AS last FROM f GROUP BY phase, code""")
def failure_report(spark: SparkSession, sf: str) -> DataFrame:
    return failures.report(_failures(spark, sf))


@query("""
    WITH s AS (SELECT user_id % 10 AS grp, epoch(date_trunc('second', ts))::BIGINT AS a, epoch(date_trunc('second', ts))::BIGINT + 3600 + event_id % 7200 AS b FROM events),
    m AS (SELECT grp, tick, sum(d) AS d FROM (SELECT grp, a AS tick, 1 AS d FROM s UNION ALL SELECT grp, b, -1 FROM s) GROUP BY grp, tick),
    r AS (SELECT grp, sum(d) OVER (PARTITION BY grp ORDER BY tick) AS open FROM m)
    SELECT grp, max(open)::BIGINT AS peak FROM r GROUP BY grp""")
def peak_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    at = catalog.epoch(F.date_trunc("second", "ts"))
    rows = catalog.table(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), at.alias("a"), (at + 3600 + F.col("event_id") % 7200).alias("b"))
    return report.peak_concurrency(rows, "grp", "a", "b")


_KINDS = """WITH r AS (
    SELECT 'metadata' AS kind, 'dir' AS type, MAP {'path': '/ds/' || replace(o_orderpriority, ' ', '_') || '/' || o_orderkey, 'mode': '755'} AS fields FROM orders
    UNION ALL SELECT 'control', CASE WHEN doc_id % 2 = 0 THEN 'copy_file' ELSE 'delete_file' END, MAP {'path': doc_id || '.txt', 'diff': lang, 'source': source} FROM documents
    UNION ALL SELECT 'index', 'url', MAP {'url': url} FROM pages)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    def kind(rows: DataFrame, name: str, type_, **fields) -> DataFrame:
        pairs = [c for k, v in fields.items() for c in (F.lit(k), v)]
        return rows.select(F.lit(name).alias("kind"), type_.alias("type"), F.create_map(*pairs).alias("fields"))

    docs = catalog.table(spark, sf, "documents")
    even = F.when(F.col("doc_id") % 2 == 0, "copy_file").otherwise("delete_file")
    return report.inspect_union(
        kind(catalog.dirs(spark, sf), "metadata", F.lit("dir"), path=F.col("path"), mode=F.lit("755")),
        kind(docs, "control", even, path=F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), diff=F.col("lang"), source=F.col("source")),
        kind(catalog.table(spark, sf, "pages"), "index", F.lit("url"), url=F.col("url")),
    )


@query(_KINDS + """ SELECT kind, type, count(DISTINCT n)::BIGINT AS n, string_agg(DISTINCT k, ',' ORDER BY k) AS columns, max(length(v))::INTEGER AS width
    FROM (SELECT kind, type, row_number() OVER () AS n, unnest(map_entries(fields)).key AS k, unnest(map_entries(fields)).value AS v FROM r) GROUP BY kind, type""")
def inspect_union(spark: SparkSession, sf: str) -> DataFrame:
    return report.group_records(_records(spark, sf))


@query("""
    SELECT 'metadata' AS kind, o_orderkey AS id, o_orderstatus AS status, NULL::VARCHAR AS lang, NULL::VARCHAR AS url FROM orders
    UNION ALL SELECT 'control', doc_id, NULL, lang, NULL FROM documents UNION ALL SELECT 'index', page_id, NULL, NULL, url FROM pages""")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name: catalog.table(spark, sf, name)
    return report.inspect_union(
        t("orders").select(F.lit("metadata").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
        t("documents").select(F.lit("control").alias("kind"), F.col("doc_id").alias("id"), "lang"),
        t("pages").select(F.lit("index").alias("kind"), F.col("page_id").alias("id"), "url"),
    )


@query(with_views(
    """SELECT id, printf('%o', 33188 + line) AS mode, printf('%08X', hash % 4294967296) AS hash_hex, CASE WHEN size >= 1048576 THEN printf('%.2f MiB', size / 1048576.0::DOUBLE)
        WHEN size >= 1024 THEN printf('%.2f KiB', size / 1024.0::DOUBLE) ELSE size || ' B' END AS size_text,
        '&lt;' || name || ' a=&quot;' || line || '&quot;&gt;' AS escaped, (size // 512 * 512 - 512)::BIGINT AS hole_off, (size - (size // 512 * 512 - 512))::BIGINT AS hole_len
    FROM vfiles""", "vfiles"))  # fmt: skip
def inspect_render(spark: SparkSession, sf: str) -> DataFrame:
    stored = F.floor(F.col("size") / 512).cast("long") - 1
    raw = F.concat(F.lit("<"), "name", F.lit(' a="'), F.col("line").cast("string"), F.lit('">'))
    rows = catalog.files(spark, sf).withColumn("hole", F.get(scalars.sparse_ranges(F.col("size"), stored), F.lit(0)))
    return rows.select(
        "id", scalars.octal(F.col("line") + 33188).alias("mode"), scalars.hash_hex(F.col("hash") % (1 << 32)).alias("hash_hex"),
        scalars.format_bytes(F.col("size")).alias("size_text"), scalars.xml_escape(raw).alias("escaped"),
        F.col("hole.off").alias("hole_off"), F.col("hole.len").alias("hole_len"),
    )


@query("""
    SELECT coalesce(event_type, '*') AS job, CASE WHEN GROUPING(user_id % 3) = 1 THEN -1 ELSE user_id % 3 END::BIGINT AS subtask, count(*)::BIGINT AS n,
        sum(round(value * 100)::BIGINT)::BIGINT AS cents, max(round(value * 100)::BIGINT)::BIGINT AS most
    FROM events GROUP BY ROLLUP (event_type, user_id % 3)""")
def job_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.table(spark, sf, "events").select(
        F.col("event_type").alias("job"), (F.col("user_id") % 3).alias("subtask"), F.round(F.col("value") * 100).cast("long").alias("cents")
    )
    out = rows.rollup("job", "subtask").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total"), F.max("cents").alias("most"))
    return out.select(F.coalesce("job", F.lit("*")).alias("job"), F.coalesce("subtask", F.lit(-1)).alias("subtask"), "n", F.col("total").alias("cents"), "most")


_ROUTES = (("/b", "r1"), ("/blog.", "r2"), ("/blog.t", "r3"), ("/m.", "r4"), ("/th", "r5"), ("/spam-farm.example.org/en", "r6"))


@query(with_views(
    f"""SELECT v.id, v.path, (SELECT arg_max(route, length(prefix)) FROM (VALUES {', '.join(map(str, _ROUTES))}) r(prefix, route) WHERE starts_with(v.path, prefix)) AS route
    FROM vurls v""", "vurls"))  # fmt: skip
def route_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    routes = spark.createDataFrame(list(_ROUTES), "prefix string, route string")
    return report.longest_prefix(catalog.urls(spark, sf).select("id", "path"), routes, "path")


@query(with_views(
    """SELECT id, CASE id % 6 WHEN 0 THEN size * 1 WHEN 1 THEN size * 1024 WHEN 2 THEN size * 1536 WHEN 3 THEN size * 1048576 WHEN 4 THEN size * 1073741824 END::BIGINT AS bytes,
        CASE WHEN size >= 1024 THEN printf('%.2fKiB', size / 1024.0::DOUBLE) ELSE size || 'B' END AS compact,
        CASE WHEN size >= 1024 THEN printf('%.2f KB', size / 1024.0::DOUBLE) ELSE printf('%.2f B', size::DOUBLE) END AS decimal_style,
        CASE WHEN size * 97 < 60000 THEN printf('%d.%03ds', size * 97 // 1000, size * 97 % 1000)
            ELSE printf('%dm %d.%03ds', size * 97 // 60000, size * 97 // 1000 % 60, size * 97 % 1000) END AS elapsed,
        round(CASE WHEN id % 10 > 0 THEN size / (id % 10)::DOUBLE ELSE size END * 1000)::BIGINT AS rate_milli, least(greatest(size * 100, 262144), 4194304)::BIGINT AS buffer,
        CASE WHEN id % 3 > 0 THEN least(greatest(id % 3 * 30, 1), 32) ELSE least(greatest(id % 7, 1) * 8, 32) END::INTEGER AS tasks
    FROM vdocs""", "vdocs"))  # fmt: skip
def size_parse_format(spark: SparkSession, sf: str) -> DataFrame:
    n, size = F.col("id"), F.col("size")
    text = F.concat(F.when(n % 6 == 2, F.concat((size * 3 / 2).cast("decimal(20,1)").cast("string"))).otherwise(size.cast("string")), F.get(F.array(*map(F.lit, ("", "k", " KB", "M", "gb", "x"))), (n % 6).cast("int")))
    return catalog.docs(spark, sf).select(
        "id", scalars.parse_size(text).alias("bytes"), scalars.format_bytes(size, spaced=False).alias("compact"),
        scalars.format_bytes_units(size, ("B", "KB", "MB", "GB", "TB", "PB")).alias("decimal_style"), scalars.format_duration(size * 97).alias("elapsed"),
        F.round(scalars.rate(size, n % 10) * 1000).cast("long").alias("rate_milli"), scalars.clamp_copy_buffer(size * 100).alias("buffer"),
        scalars.copy_task_limit((n % 7).cast("int"), (n % 3 * 30).cast("int")).alias("tasks"),
    )


@query("""
    SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS unix, ((epoch(date_trunc('second', ts))::BIGINT + 11644473600) * 10000000)::BIGINT AS ticks,
        CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch(date_trunc('second', ts))::BIGINT END::BIGINT AS back, greatest((event_id % 100) * 100000000000000 // 10000000 - 11644473600, 0)::BIGINT AS early FROM events""")
def filetime_convert(spark: SparkSession, sf: str) -> DataFrame:
    unix, n = catalog.epoch(F.date_trunc("second", "ts")), F.col("event_id")
    ticks = scalars.unix_to_filetime(unix)
    return catalog.table(spark, sf, "events").select(
        "event_id", unix.alias("unix"), ticks.alias("ticks"), scalars.filetime_to_unix(F.when(n % 5 == 0, 0).otherwise(ticks)).alias("back"),
        scalars.filetime_to_unix((n % 100) * 100_000_000_000_000).alias("early"),
    )


_TASKS = """WITH e AS (SELECT user_id AS task, event_id AS seq, CASE user_id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'backup' ELSE 'restore' END AS kind,
    CASE WHEN event_type = 'view' THEN 'created' WHEN event_type = 'signup' THEN 'starting' WHEN event_type = 'click' THEN 'running' WHEN event_type = 'purchase' THEN 'stopping'
        WHEN event_id % 50 = 0 THEN 'failed' ELSE 'running' END AS state FROM events),
    s AS (SELECT task, kind, coalesce(arg_min(state, seq) FILTER (state IN ('completed', 'failed', 'killed', 'stopped')), arg_max(state, seq)) AS state, count(*)::BIGINT AS events FROM e GROUP BY task, kind)"""


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("scan", "backup", "restore"))), (F.col("user_id") % 3).cast("int"))
    kinds = {"view": "create", "signup": "start", "click": "run", "purchase": "stop"}
    event = F.when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0), "exit_error")
    for name, what in kinds.items():
        event = event.when(F.col("event_type") == name, what)
    rows = catalog.table(spark, sf, "events")
    return tasks.states(rows.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), kind.alias("kind"), event.otherwise("run").alias("event")), "task", "seq")


@query(_TASKS + " SELECT task, kind, state, events FROM s")
def task_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    return _tasks(spark, sf)


@query(_TASKS + """ SELECT CASE WHEN kind = 'scan' THEN 'scan' ELSE 'subtask' END AS pool, count(*) FILTER (state IN ('created', 'starting', 'running', 'stopping'))::BIGINT AS active,
    count(*)::BIGINT AS tasks, count(*) FILTER (state IN ('created', 'starting', 'running', 'stopping')) >= 4 AS refused FROM s GROUP BY 1""")
def task_limits(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.active_by_kind(_tasks(spark, sf), {"scan": 4, "subtask": 4})


@query("""
    SELECT s.conv_id, '1.0' AS version, 'common' AS format, 64::BIGINT AS blob_mib, count(*)::BIGINT AS subtasks, count(*) FILTER (role = 'user')::BIGINT AS succeeded
    FROM conversations s GROUP BY s.conv_id""")
def manifest_json(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests written as JSON and read back; absent settings take their defaults."""
    from lithos.sources.manifest import read_manifest, write_manifest

    subtasks = catalog.table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("string").alias("id"), (F.col("role") == "user").alias("succeeded"))
    back = read_manifest(write_manifest(subtasks, "conv_id"), "json")
    return back.select(
        "conv_id", "m.version", "m.format", (F.col("m.aggregation.max_blob_size") / (1 << 20)).cast("long").alias("blob_mib"),
        F.size("m.subtasks").cast("long").alias("subtasks"), F.size(F.filter("m.subtasks", lambda s: s["succeeded"])).cast("long").alias("succeeded"),
    )


@query("""
    WITH o(name, depth, dirs, files, size) AS (VALUES ('1K', 1, 5, 1000, 1024), ('depth_4', 4, 3, 30, 8192), ('depth_10', 10, 2, 8, 2048), ('50K_files', 4, 5, 100, 1024)),
    l AS (SELECT *, unnest(range(depth)) AS level FROM o)
    SELECT name, sum(pow(dirs, level + 1))::BIGINT AS n_dirs, sum(pow(dirs, level) * files)::BIGINT AS n_files, sum(pow(dirs, level) * files * size)::BIGINT AS bytes FROM l GROUP BY name""")
def fileset_estimate(spark: SparkSession, sf: str) -> DataFrame:
    from lithos.sources.fileset import estimate

    cases = [("1K", 1, 5, 1000, 1024), ("depth_4", 4, 3, 30, 8192), ("depth_10", 10, 2, 8, 2048), ("50K_files", 4, 5, 100, 1024)]
    return estimate(spark.createDataFrame(cases, "name string, depth int, dirs long, files long, size long"))


@query("""
    WITH e AS (SELECT event_type, user_id, epoch(date_trunc('second', ts))::BIGINT AS t, round(value * 100)::BIGINT AS cents, lead(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events)
    SELECT event_type, count(*)::BIGINT AS n, sum(cents)::BIGINT AS total, max(cents)::BIGINT AS most, (sum(cents) // count(*))::BIGINT AS average, count(nxt)::BIGINT AS followed,
        coalesce(sum(nxt - t), 0)::BIGINT AS wait FROM e GROUP BY event_type""")
def transfer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Count, sum, maximum and average by operation, and how long until the user's next one."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    at = catalog.epoch(F.date_trunc("second", "ts"))
    rows = catalog.table(spark, sf, "events").select("event_type", at.alias("t"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.lead(at).over(own).alias("next"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total"), F.max("cents").alias("most"), F.floor(F.sum("cents") / F.count(F.lit(1))).cast("long").alias("average"),
        F.count("next").alias("followed"), F.coalesce(F.sum(F.col("next") - F.col("t")), F.lit(0)).alias("wait"),
    )
