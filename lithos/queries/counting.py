"""Queries over counters, and over operators that other queries use only in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos import catalog
from lithos.catalog import with_views
from lithos.functions import paths, scalars
from lithos.operators import counters, diff, filters, links, report, restore, tasks
from lithos.queries import query
from lithos.queries.reports import _KINDS, _records
from lithos.session import scratch, ship_package
from lithos.sources import sinks
from lithos.sources.fstree import FsTree, checksums

_ENTRIES = """, e AS (SELECT 'file' AS kind, size, id % 11 = 0 AS failed, false AS is_root FROM vfiles
    UNION ALL SELECT 'dir', NULL, dir_id % 13 = 0, dir_id % 17 = 0 FROM vdirs)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    f = catalog.files(spark, sf).select(F.lit("file").alias("kind"), "size", (F.col("id") % 11 == 0).alias("failed"), F.lit(False).alias("is_root"))
    d = catalog.dirs(spark, sf).select(F.lit("dir").alias("kind"), F.lit(None).cast("long").alias("size"), (F.col("dir_id") % 13 == 0).alias("failed"), (F.col("dir_id") % 17 == 0).alias("is_root"))
    return f.unionByName(d)


_SCANNED = """ SELECT coalesce(sum(size) FILTER (kind = 'file' AND NOT failed), 0)::BIGINT AS tot_size, count(*) FILTER (kind = 'file' AND NOT failed)::BIGINT AS tot_files,
    count(*) FILTER (kind = 'dir' AND NOT failed AND NOT is_root)::BIGINT AS tot_dirs, count(*) FILTER (kind = 'file' AND failed)::BIGINT AS failed_files,
    count(*) FILTER (kind = 'dir' AND failed)::BIGINT AS failed_dirs FROM e"""


@query(with_views(_ENTRIES + _SCANNED, "vdirs", "vfiles"))
def scan_counters(spark: SparkSession, sf: str) -> DataFrame:
    return counters.counted(_entries(spark, sf), counters.scan_counters())


@query(with_views(_ENTRIES + _SCANNED, "vdirs", "vfiles"))
def scan_counters_observed(spark: SparkSession, sf: str) -> DataFrame:
    """The same counters, observed while the entries go to a sink that keeps nothing."""
    rows, watch = counters.observed(_entries(spark, sf), counters.scan_counters(), "scan")
    sinks.stats_only(rows)
    names = list(counters.scan_counters())
    return spark.createDataFrame([tuple(watch.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(with_views(
    """, s AS (SELECT 'copy' AS op, 'file' AS kind, size, CASE WHEN id % 19 = 0 THEN 'source' WHEN id % 23 = 0 THEN 'target' END AS failed FROM vfiles WHERE line < 5
        UNION ALL SELECT 'delete', 'file', NULL, CASE WHEN id % 29 = 0 THEN 'target' END FROM vfiles WHERE line >= 5
        UNION ALL SELECT CASE WHEN dir_id % 2 = 0 THEN 'mkdir' ELSE 'delete' END, 'dir', NULL, CASE WHEN dir_id % 31 = 0 THEN 'target' END FROM vdirs)
    SELECT coalesce(sum(size) FILTER (op = 'copy' AND failed IS NULL), 0)::BIGINT AS bytes_copied,
        count(*) FILTER (op = 'copy' AND failed IS DISTINCT FROM 'source')::BIGINT AS src_opened, count(*) FILTER (op = 'copy' AND failed IS DISTINCT FROM 'source')::BIGINT AS src_closed,
        count(*) FILTER (op = 'copy' AND failed IS NULL)::BIGINT AS dst_opened, count(*) FILTER (op = 'copy' AND failed IS NULL)::BIGINT AS dst_closed,
        count(*) FILTER (op = 'copy' AND failed IS NULL)::BIGINT AS files_copied, count(*) FILTER (op = 'delete' AND kind = 'file' AND failed IS NULL)::BIGINT AS files_deleted,
        count(*) FILTER (op = 'mkdir' AND failed IS NULL)::BIGINT AS dirs_created, count(*) FILTER (op = 'delete' AND kind = 'dir' AND failed IS NULL)::BIGINT AS dirs_deleted,
        count(*) FILTER (kind = 'file' AND failed IS NOT NULL)::BIGINT AS files_failed, count(*) FILTER (kind = 'dir' AND failed IS NOT NULL)::BIGINT AS dirs_failed FROM s""", "vdirs", "vfiles"))  # fmt: skip
def transfer_counters(spark: SparkSession, sf: str) -> DataFrame:
    files, n, d = catalog.files(spark, sf), F.col("id"), F.col("dir_id")
    none = F.lit(None).cast("long")
    op = F.when(F.col("line") < 5, "copy").otherwise("delete")
    lost = F.when(op == "copy", F.when(n % 19 == 0, "source").when(n % 23 == 0, "target")).otherwise(F.when(n % 29 == 0, "target"))
    f = files.select(op.alias("op"), F.lit("file").alias("kind"), F.when(op == "copy", F.col("size")).alias("size"), lost.alias("failed"))
    g = catalog.dirs(spark, sf).select(F.when(d % 2 == 0, "mkdir").otherwise("delete").alias("op"), F.lit("dir").alias("kind"), none.alias("size"), F.when(d % 31 == 0, "target").alias("failed"))
    return counters.counted(f.unionByName(g), counters.transfer_counters())


_RESTORE = """, j AS (SELECT c.dir_id, c.name, c.size, c.mtime AS s, p.mtime AS t, p.dir_id IS NOT NULL AS there FROM curr_files c LEFT JOIN prev_files p ON p.dir_id = c.dir_id AND p.name = c.name),
    b AS (SELECT dir_id, name, size, CASE WHEN size < 20000 THEN 'blob' ELSE 'plain' END AS source, NOT there OR s > t AS should, (dir_id + length(name)) % 37 = 0 AS failed FROM j)"""


def _restored(spark: SparkSession, sf: str) -> DataFrame:
    """Files with where they come from and whether the policy keep_newer restores them."""
    files = catalog.curr_files(spark, sf).withColumn("path", F.concat(F.col("dir_id").cast("string"), F.lit("/"), "name"))
    index = files.filter("size < 20000").select("path", F.lit(0).cast("long").alias("blob"))
    there = catalog.prev_files(spark, sf).select("dir_id", "name", F.col("mtime").alias("t"), F.lit(True).alias("there"))
    found = restore.lookup(files, index).join(there, ["dir_id", "name"], "left")
    should = restore.should_restore(F.lit("keep_newer"), F.col("mtime"), F.coalesce("there", F.lit(False)), F.col("t"))
    return found.select("dir_id", "name", "size", "source", should.alias("should"), ((F.col("dir_id") + F.length("name")) % 37 == 0).alias("failed"))


@query(with_views(_RESTORE + " SELECT dir_id, name, source, should FROM b", "curr_files", "prev_files"))
def restore_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Each file's source (blob or plain) and whether it is restored, in one query."""
    return _restored(spark, sf).select("dir_id", "name", "source", "should")


@query(with_views(
    _RESTORE + """ SELECT count(*) FILTER (should AND NOT failed)::BIGINT AS files_restored, coalesce(sum(size) FILTER (should AND NOT failed), 0)::BIGINT AS bytes_restored,
        count(*) FILTER (NOT should)::BIGINT AS files_skipped, coalesce(sum(size) FILTER (NOT should), 0)::BIGINT AS bytes_skipped,
        count(*) FILTER (should AND failed)::BIGINT AS files_failed, (SELECT count(*) FROM curr_dirs)::BIGINT AS dirs_created,
        count(*) FILTER (source = 'blob')::BIGINT AS index_hits, count(*) FILTER (source = 'plain')::BIGINT AS index_misses FROM b""", "curr_files", "prev_files", "curr_dirs"))  # fmt: skip
def restore_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What a restore did, and how often the blob index had the file."""
    files = _restored(spark, sf).withColumn("kind", F.lit("file"))
    none = F.lit(None)
    dirs = catalog.curr_dirs(spark, sf).select("dir_id", none.cast("string").alias("name"), none.cast("long").alias("size"), none.cast("string").alias("source"), F.lit(True).alias("should"), F.lit(False).alias("failed"), F.lit("dir").alias("kind"))
    more = {"index_hits": F.count_if(F.col("source") == "blob"), "index_misses": F.count_if(F.col("source") == "plain")}
    return counters.counted(files.unionByName(dirs), counters.restore_counters() | more)


@query(with_views(
    """, p AS (SELECT CASE id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'mtime' ELSE 'hardlink' END AS phase, id % 8 = 0 AS missing, id % 21 = 0 AS failed, id % 4 = 2 AS ahead FROM vdocs),
    a AS (SELECT *, CASE phase WHEN 'hardlink' THEN ahead ELSE missing END AS skipped FROM p)
    SELECT phase, count(*)::BIGINT AS processed, count(*) FILTER (NOT skipped AND NOT failed)::BIGINT AS ok, count(*) FILTER (NOT skipped AND failed)::BIGINT AS failed,
        count(*) FILTER (skipped)::BIGINT AS skipped FROM a GROUP BY phase""", "vdocs"))  # fmt: skip
def phase_counters(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id")
    there = n % 8 != 0
    action = (
        F.when(n % 3 == 0, restore.delete_action(F.lit("File"), there, F.lit(False))).when(n % 3 == 1, restore.mtime_action(there))
        .otherwise(F.when(n % 4 == 2, "primary").otherwise("link"))
    )
    phase = F.get(F.array(*map(F.lit, ("delete", "mtime", "hardlink"))), (n % 3).cast("int"))
    return counters.phase_counters(catalog.docs(spark, sf).select(phase.alias("phase"), action.alias("action"), (n % 21 == 0).alias("failed")))


@query(with_views(
    """, s AS (SELECT path, size, checksum FROM vdocs WHERE id % 10 <> 0), t AS (SELECT path, size + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS size, checksum || CASE WHEN id % 7 = 0 THEN 'x' ELSE '' END AS checksum FROM vdocs WHERE id % 11 <> 0)
    SELECT CASE WHEN t.path IS NULL THEN 'source_only' WHEN s.path IS NULL THEN 'target_only' WHEN s.size <> t.size THEN 'size_mismatch' WHEN s.checksum <> t.checksum THEN 'checksum_mismatch' ELSE 'identical' END AS status,
        count(*)::BIGINT AS n FROM s FULL JOIN t ON t.path = s.path GROUP BY 1
    UNION ALL SELECT 'mtime_mismatch', count(*)::BIGINT FROM vdirs WHERE dir_id % 3 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'identical dirs', count(*)::BIGINT FROM vdirs""", "vdocs", "vdirs"))  # fmt: skip
def tree_compare_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Compared files and directories by status; directories are told apart to count them."""
    n, docs = F.col("id"), catalog.docs(spark, sf)
    plain = [F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("symlink_target"), F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("mtime")]
    source = docs.filter("id % 10 <> 0").select("path", *plain, "size", "checksum")
    target = docs.filter("id % 11 <> 0").select("path", *plain, (F.col("size") + F.when(n % 9 == 0, 1).otherwise(0)).alias("size"), F.concat("checksum", F.when(n % 7 == 0, "x").otherwise("")).alias("checksum"))
    folder = lambda late: catalog.dirs(spark, sf).select(
        "path", F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("symlink_target"), F.lit(True).alias("is_dir"),
        (F.col("mtime") + F.when((F.col("dir_id") % 3 == 0) & F.lit(late), 1).otherwise(0)).alias("mtime"), F.lit(0).cast("long").alias("size"), F.lit("").alias("checksum"),
    )
    files = diff.compare_trees(source, target)
    dirs = diff.compare_trees(folder(False), folder(True), compare_mtime=True)
    own = dirs.withColumn("status", F.concat("status", F.lit(" dirs")))
    return counters.by_status(files.unionByName(own))


@query(_KINDS + """, v AS (SELECT kind, type, unnest(map_entries(fields)) AS x FROM r)
    SELECT kind, type, x.key AS "column", count(*)::BIGINT AS n, greatest(length(x.key), max(length(x.value)))::INTEGER AS width FROM v GROUP BY kind, type, x.key""")
def inspect_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The width of each column of each group of records."""
    return report.column_widths(_records(spark, sf))


@query(_KINDS + """ SELECT 'tab' AS format, kind || chr(9) || type || chr(9) || coalesce(fields['path'], '') || chr(9) || coalesce(fields['mode'], '') AS line FROM r
    UNION ALL SELECT 'csv', kind || ',' || type || ',' || coalesce(fields['path'], '""') || ',' || coalesce(fields['mode'], '""') FROM r
    UNION ALL SELECT 'table', rtrim(rpad(coalesce(fields['path'], ''), (SELECT greatest(4, max(length(fields['path']))) FROM r)::INTEGER, ' ') || '  ' ||
        rpad(coalesce(fields['mode'], ''), (SELECT greatest(4, max(length(fields['mode']))) FROM r)::INTEGER, ' ')) FROM r""")
def inspect_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Records as lines of three formats."""
    rows, columns = _records(spark, sf), ["path", "mode"]
    widths = report.column_widths(rows).groupBy("column").agg(F.max("width").alias("width"))
    out = report.as_table(rows, widths, columns).select(F.lit("table").alias("format"), "line")
    for fmt in ("tab", "csv"):
        out = out.unionByName(report.as_lines(rows, columns, fmt).select(F.lit(fmt).alias("format"), "line"))
    return out


@query(with_views(
    """, b AS (SELECT id, dir, checksum, size, row_number() OVER (PARTITION BY dir ORDER BY id) AS n FROM vdocs)
    SELECT id, n % 5 = 0 AS out_of_range, CASE WHEN n % 5 <> 0 THEN sha256(id || ':' || size || ';') END AS content_sha256 FROM b""", "vdocs"))  # fmt: skip
def blob_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Small contents joined to blobs and cut out again by their index; every fifth row of the index points behind its blob."""
    own = Window.partitionBy("dir").orderBy("id")
    content = F.concat(F.col("id").cast("string"), F.lit(":"), F.col("size").cast("string"), F.lit(";"))
    rows = catalog.docs(spark, sf).select("id", F.col("dir").alias("bucket"), F.floor(F.col("id") / 100).cast("long").alias("blob"), content.cast("binary").alias("content"), F.row_number().over(own).alias("n"))
    rows = rows.withColumn("size", F.octet_length("content").cast("long"))
    before = Window.partitionBy("bucket", "blob").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    index = rows.select("id", "bucket", "blob", (F.col("offset") + F.when(F.col("n") % 5 == 0, 1 << 30).otherwise(0)).alias("offset"), "size")
    found = sinks.read_from_blobs(index, sinks.blob_contents(rows))
    return found.select("id", "out_of_range", F.sha2("content", 256).alias("content_sha256"))


@query(with_views(
    """SELECT dir, name, arg_max(id, id)::BIGINT AS id FROM (SELECT dir, (id % 50) || '.txt' AS name, id FROM vdocs) GROUP BY dir, name""", "vdocs"))  # fmt: skip
def dir_index_table(spark: SparkSession, sf: str) -> DataFrame:
    """The index of each directory, written by a hash of directories and read again."""
    path = scratch(spark, "dirindex")
    rows = catalog.docs(spark, sf).select("dir", F.concat((F.col("id") % 50).cast("string"), F.lit(".txt")).alias("name"), F.col("id").alias("seq"), "id")
    sinks.write_dir_index(rows, path)
    return sinks.read_dir_index(spark, path).select("dir", "name", "id")


@query(with_views(
    """SELECT shard, count(*) FILTER (kind = 'DIR')::BIGINT AS dirs, count(*) FILTER (kind = 'FILE')::BIGINT AS files FROM (
        SELECT d.shard, x.kind FROM (SELECT dir_id, path, (FNV % 6)::BIGINT AS shard FROM vdirs) d,
            (SELECT 'DIR' AS kind, dir_id FROM vdirs UNION ALL SELECT 'FILE', dir_id FROM vfiles) x WHERE x.dir_id = d.dir_id) GROUP BY shard""", "vdirs", "vfiles").replace(
    "FNV", __import__("lithos.queries.paths", fromlist=["_fnv_sql"])._fnv_sql("path", 0xCBF29CE484222325)))
def plan_table(spark: SparkSession, sf: str) -> DataFrame:
    """A plan table written by shard, rewritten with its paths mapped, and its header."""
    first, second = scratch(spark, "plan"), scratch(spark, "plan")
    dirs = catalog.dirs(spark, sf)
    own = dirs.select(F.lit("DIR").alias("kind"), F.col("path").alias("dir_path"), F.lit(None).cast("string").alias("name"))
    files = catalog.files(spark, sf).join(dirs.select("dir_id", F.col("path").alias("dir_path")), "dir_id").select(F.lit("FILE").alias("kind"), "dir_path", "name")
    sinks.write_plan(own.unionByName(files), first, 6)
    sinks.rewrite_plan(spark, first, second, "dir_path", lambda c: paths.physical_to_logical(F.concat(F.lit("/mnt"), c), "/mnt", "/"))
    return sinks.plan_header(spark.read.parquet(second))


@query(with_views(
    "SELECT snapshot, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM (SELECT unnest(['s1', 's2']) AS snapshot, size FROM vfiles) GROUP BY snapshot", "vfiles"))
def catalog_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots appended to a catalog, the first one twice."""
    path = scratch(spark, "catalog")
    files, dirs = catalog.files(spark, sf), catalog.dirs(spark, sf)
    for snapshot in ("s1", "s2", "s1"):
        sinks.write_catalog(files, dirs, path, snapshot)
    parts = [sinks.read_snapshot(spark, path, "files", s).agg(F.lit(s).alias("snapshot"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")) for s in ("s1", "s2")]
    return parts[0].unionByName(parts[1])


@query(with_views(
    """SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 = 0 THEN 16749 ELSE 16877 END ELSE CASE WHEN id % 3 = 0 THEN 33060 ELSE 33188 END END AS mode,
        size > 0 AND size < 2000 AND id % 4 = 0 AS aggregate_block, id % 2 = id % 3 AND id % 5 = 1 AS linked, starts_with(path, dir || '/') AS below, id % 6 <> 0 OR id % 4 <> 0 AS logged,
        string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] AS last_two, dir || '/' || name AS joined, CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END::BIGINT AS folded, round(size / 7.0::DOUBLE * 1000)::BIGINT AS rate_milli
    FROM (SELECT *, xor(('0x' || md5(path)[1:16])::UBIGINT, ('0x' || md5(path)[17:32])::UBIGINT)::HUGEINT AS x FROM vdocs)""", "vdocs"))  # fmt: skip
def small_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of one row: modes, blocks for blobs, links, ancestors, suppressed log records, path ends, rates."""
    n, size = F.col("id"), F.col("size")
    message = F.when(n % 4 == 0, "Error closing file: Network Name Deleted (0xc00000c9)").otherwise("Error closing file: busy")
    return catalog.docs(spark, sf).select(
        "id", scalars.synthesize_mode(n % 2 == 0, n % 3 == 0).alias("mode"),
        filters.should_aggregate_block(size, F.when(n % 4 == 0, 0).otherwise(512), size, 2000).alias("aggregate_block"),
        links.already_linked(n % 2, n % 5, n % 3, F.lit(1)).alias("linked"), paths.is_ancestor(F.col("dir"), F.col("path")).alias("below"),
        (~filters.suppressed(F.when(n % 6 == 0, "smb::resource").otherwise("nfs"), message)).alias("logged"), paths.last_components(F.col("path"), 2).alias("last_two"),
        F.concat(F.lit("/"), paths.join_relative(F.ltrim("dir", F.lit("/")), F.col("name"))).alias("joined"),
        scalars.fold_id(F.md5("path")).alias("folded"), F.round(scalars.rate(size, F.lit(7)) * 1000).cast("long").alias("rate_milli"),
    )


@query("""SELECT user_id AS task, max(event_id)::BIGINT AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def task_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each task."""
    rows = catalog.table(spark, sf, "events").select(F.col("user_id").alias("task"), "event_id", "event_type")
    return tasks.latest(rows, "task", "event_id")


@query(with_views(
    """, f AS (SELECT dir_id, count(*) AS n FROM vfiles WHERE dir_id % 3 = 0 GROUP BY dir_id)
    SELECT d.dir_id, d.path FROM vdirs d LEFT JOIN f ON f.dir_id = d.dir_id WHERE d.dir_id % 5 = 0 OR coalesce(f.n, 0) > 0""", "vdirs", "vfiles"))  # fmt: skip
def nonempty_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Directories that pass a filter themselves or hold files that do."""
    counts = catalog.files(spark, sf).filter("dir_id % 3 = 0").groupBy("dir_id").agg(F.count(F.lit(1)).alias("n"))
    rows = catalog.dirs(spark, sf).join(counts, "dir_id", "left")
    return filters.drop_empty_dirs(rows, F.col("dir_id") % 5 == 0, F.coalesce("n", F.lit(0))).select("dir_id", "path")


@query("""
    SELECT 'local' AS spec, '/srv/data' AS base, '/' AS root UNION ALL SELECT 'nfs', '/export', '/home' UNION ALL SELECT 'smb', '/', '/share'""")
def source_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """A local source is its own base; a remote one has its parent as base and its last segment as root."""
    rows = spark.createDataFrame([("local", "/srv/data"), ("nfs", "nfs://h/export/home"), ("smb", "smb://h/share")], "spec string, location string")
    layout = paths.source_layout(F.col("location"))
    return rows.select("spec", layout["base"].alias("base"), layout["root"].alias("root"))


def _region_folder(spark: SparkSession, sf: str) -> str:
    """A folder of text files, one a region, in a folder of its own each."""
    path = scratch(spark, "tree")
    rows = catalog.table(spark, sf, "region").select("r_name", F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("value"))
    rows.repartition("r_name").write.partitionBy("r_name").text(path)
    return path


@query("""
    SELECT 'dir' AS kind, '/' AS parent, count(*)::BIGINT AS n FROM region UNION ALL SELECT 'root', '/', 1
    UNION ALL SELECT 'file', '/', 1 UNION ALL SELECT 'file', '/r_name=' || r_name, count(*) FROM region GROUP BY r_name""")
def tree_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The walk of a folder: entries of each kind below each directory (the writer leaves a file of its own at the top)."""
    ship_package(spark)
    spark.dataSource.register(FsTree)
    root = _region_folder(spark, sf).removeprefix("file://")
    rows = spark.read.format("fstree").load(root)
    kind = F.when(F.col("path") == "/", "root").otherwise(F.col("kind"))
    return rows.groupBy(kind.alias("kind"), F.col("dir").alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '/r_name=' || r_name AS parent, strlen('region ' || r_regionkey)::BIGINT + 1 AS size, sha256('region ' || r_regionkey || chr(10)) AS checksum FROM region")
def checksum_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a folder with the digests of their contents; spellings that URIs change are changed back."""
    found = checksums(spark, _region_folder(spark, sf))
    parent = F.url_decode(F.replace(F.regexp_replace("path", "/[^/]*$", ""), F.lit("+"), F.lit("%2B")))
    return found.select(parent.alias("parent"), "size", "checksum")
