"""Queries over blobs, shards, batches and hard links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos import catalog
from lithos.catalog import with_views
from lithos.functions import hashing
from lithos.operators import links, packing, ranking, restore
from lithos.operators.filters import should_aggregate
from lithos.plans import control
from lithos.queries import query
from lithos.queries.paths import _fnv_sql

#: Eligible files are under the threshold; a blob closes at BLOB bytes.
THRESHOLD, BLOB = 4000, 10_000

_LINKED = """, l AS (SELECT id AS seq, checksum AS key, id % 2 AS devno, path, count(*) OVER (PARTITION BY checksum, id % 2)::BIGINT AS links FROM vdocs)"""
_PACKED = f""", e AS (SELECT id, dir, path, size, row_number() OVER (PARTITION BY dir ORDER BY id) AS rn FROM vdocs WHERE size > 0 AND size < {THRESHOLD}),
    RECURSIVE k AS (SELECT id, dir, path, size, rn, 0::BIGINT AS blob, 0::BIGINT AS "offset" FROM e WHERE rn = 1
        UNION ALL SELECT e.id, e.dir, e.path, e.size, e.rn, CASE WHEN k."offset" + k.size >= {BLOB} THEN k.blob + 1 ELSE k.blob END,
            CASE WHEN k."offset" + k.size >= {BLOB} THEN 0 ELSE k."offset" + k.size END FROM k JOIN e ON e.dir = k.dir AND e.rn = k.rn + 1)"""


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of equal text and parity as names of one file."""
    rows = catalog.docs(spark, sf).select(F.col("id").alias("seq"), F.col("checksum").alias("id"), (F.col("id") % 2).alias("devno"), "path")
    return rows.withColumn("links", F.count(F.lit(1)).over(Window.partitionBy("id", "devno")))


@query(with_views(
    _LINKED + """ SELECT key AS id, devno, count(*)::BIGINT AS link_count, string_agg(path, ',' ORDER BY seq) AS paths FROM l GROUP BY key, devno HAVING count(*) >= 2""", "vdocs"))
def hardlink_groups(spark: SparkSession, sf: str) -> DataFrame:
    return links.restore_groups(_linked(spark, sf)).withColumn("paths", F.array_join("paths", ","))


@query(with_views(
    _LINKED + """ SELECT devno, key AS id, links AS link_count, string_agg(path, ',' ORDER BY seq) AS paths FROM l WHERE links > 1 GROUP BY key, devno, links""", "vdocs"))
def hardlink_scan_groups(spark: SparkSession, sf: str) -> DataFrame:
    return links.scan_groups(_linked(spark, sf)).withColumn("paths", F.array_join("paths", ","))


@query(with_views(
    _LINKED + """, u AS (SELECT *, count(*) OVER (PARTITION BY key, devno)::BIGINT AS members, row_number() OVER (PARTITION BY key, devno ORDER BY seq) AS rank,
        first_value(path) OVER (PARTITION BY key, devno ORDER BY seq) AS primary_path FROM l WHERE seq % 3 <> 0)
    SELECT seq, path, members, primary_path, CASE WHEN rank = 1 THEN 'primary' ELSE 'link' END AS action FROM u WHERE members >= 2""", "vdocs"))  # fmt: skip
def hardlink_primary(spark: SparkSession, sf: str) -> DataFrame:
    """Names that exist at the target (here: whose number is no multiple of 3) and what is linked to which."""
    rows = links.link_actions(_linked(spark, sf), ["id", "devno"], usable=F.col("seq") % 3 != 0)
    return rows.select("seq", "path", "members", "primary_path", "action")


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.docs(spark, sf).filter(should_aggregate(F.col("size"), THRESHOLD)).select("id", "dir", "path", "size")


@query(with_views(_PACKED + ' SELECT id, dir, size, blob, "offset" FROM k', "vdocs"))
def pack_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_greedy(_eligible(spark, sf), "dir", ["id"], "size", BLOB).select("id", "dir", "size", "blob", "offset")


@query(with_views(
    _PACKED + """ SELECT dir, blob, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes, min(id)::BIGINT AS first_id FROM k GROUP BY dir, blob""", "vdocs"))
def blob_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = packing.pack_greedy(_eligible(spark, sf), "dir", ["id"], "size", BLOB)
    return rows.groupBy("dir", "blob").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.min("id").alias("first_id"))


@query(with_views(
    f""", r AS (SELECT id, path, size, sum(size) OVER (ORDER BY id)::BIGINT AS seen FROM vdocs WHERE size > 0 AND size < {THRESHOLD}),
    n AS (SELECT *, least(greatest(seen // 100000 + 1, 1), 16) AS shards FROM r)
    SELECT id, seen, shards::BIGINT AS shards, printf('shard-%03d', ({_fnv_sql('path', hashing.BLOB_BASIS)} % shards)::BIGINT) AS bucket FROM n""", "vdocs"))  # fmt: skip
def adaptive_shard_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = packing.prefix_sum(_eligible(spark, sf), "id", "size", "seen")
    return rows.select(
        "id", "seen", packing.adaptive_shards(F.col("seen"), 100_000, 16).alias("shards"),
        packing.adaptive_bucket(F.col("path"), F.col("seen"), 100_000, 16).alias("bucket"),
    )


@query(with_views(
    _PACKED + """, b AS (SELECT dir, blob, string_agg(d.text, '' ORDER BY k.id) AS content FROM k JOIN documents d ON d.doc_id = k.id GROUP BY dir, blob)
    SELECT v.id, v.path, CASE WHEN k.id IS NULL THEN 'plain' ELSE 'blob' END AS source, k.blob, k."offset",
        k.id IS NOT NULL AND coalesce(sha256(substr(b.content, (k."offset" + 1)::BIGINT, k.size)) = v.checksum, false) AS intact
    FROM vdocs v LEFT JOIN k ON k.id = v.id LEFT JOIN b ON b.dir = k.dir AND b.blob = k.blob""", "vdocs"))  # fmt: skip
def blob_lookup_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Where each file is restored from, and whether the slice of its blob is the file again."""
    index = packing.pack_greedy(_eligible(spark, sf), "dir", ["id"], "size", BLOB).select("path", "dir", "blob", "offset", F.col("size").alias("length"))
    texts = catalog.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    files = catalog.docs(spark, sf)
    parts = files.join(index.drop("dir"), "path").join(texts, "id")
    blobs = parts.groupBy("dir", "blob").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "").alias("content"))
    found = restore.lookup(files.drop("dir"), index)
    whole = found.join(blobs, ["dir", "blob"], "left")
    slice_ = F.substring(F.col("content"), F.col("offset").cast("int") + 1, F.col("length").cast("int"))
    return whole.select("id", "path", "source", "blob", "offset", F.coalesce(F.sha2(slice_, 256) == F.col("checksum"), F.lit(False)).alias("intact"))


@query(with_views(
    """SELECT dir, name, arg_max(id, id)::BIGINT AS id, arg_max(size, id)::BIGINT AS size
    FROM (SELECT dir, (id % 50) || '.txt' AS name, id, size FROM vdocs) GROUP BY dir, name""", "vdocs"))  # fmt: skip
def dir_level_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index of each directory: of rows of one name the last wins."""
    rows = catalog.docs(spark, sf).select("dir", F.concat((F.col("id") % 50).cast("string"), F.lit(".txt")).alias("name"), "id", "size")
    return packing.last_wins(rows, ["dir", "name"], "id").select("dir", "name", "id", "size")


@query(with_views(
    """, c AS (SELECT dir_id % 100 AS grp, count(*)::BIGINT AS n FROM vdirs GROUP BY 1)
    SELECT grp, n, batch, greatest((n + 39) // 40, 1)::BIGINT AS batches, least(n - batch * 40, 40)::BIGINT AS files, batch > 0 AS is_continuation, batch = greatest((n + 39) // 40, 1) - 1 AS is_last
    FROM (SELECT grp, n, unnest(range(greatest((n + 39) // 40, 1))) AS batch FROM c)""", "vdirs"))  # fmt: skip
def batch_split(spark: SparkSession, sf: str) -> DataFrame:
    counts = catalog.dirs(spark, sf).groupBy((F.col("dir_id") % 100).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return packing.split_batches(counts, "n", 40).select("grp", "n", "batch", "batches", "files", "is_continuation", "is_last")


@query(with_views(
    """, e AS (SELECT dir_id, dir_id % 16 AS shard, 60 + length(path) AS len, row_number() OVER (PARTITION BY dir_id % 16 ORDER BY dir_id) AS rn FROM vdirs),
    RECURSIVE k AS (SELECT dir_id, shard, len, rn, 0::BIGINT AS file_index, 0::BIGINT AS entry, 0::BIGINT AS used FROM e WHERE rn = 1
        UNION ALL SELECT e.dir_id, e.shard, e.len, e.rn, CASE WHEN k.used + k.len >= 8000 OR k.entry + 1 >= 90 THEN k.file_index + 1 ELSE k.file_index END,
            CASE WHEN k.used + k.len >= 8000 OR k.entry + 1 >= 90 THEN 0 ELSE k.entry + 1 END,
            CASE WHEN k.used + k.len >= 8000 OR k.entry + 1 >= 90 THEN 0 ELSE k.used + k.len END FROM k JOIN e ON e.shard = k.shard AND e.rn = k.rn + 1)
    SELECT dir_id, shard, file_index, entry, 'copy_' || sha256('copy:shard:' || shard || ':file:' || file_index)[1:16] || '.control.bin' AS file FROM k""", "vdirs"))  # fmt: skip
def shard_rollover(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.dirs(spark, sf).select("dir_id", (F.col("dir_id") % 16).alias("shard"), (F.length("path") + 60).cast("long").alias("len"))
    out = packing.roll_over(rows, "shard", ["dir_id"], "len", 8000, 90)
    return out.select("dir_id", "shard", "file_index", "entry", hashing.sharded_copy_name(F.col("shard"), F.col("file_index")).alias("file"))


_POSITIONAL = """, p AS (SELECT dir_id % 64 AS part, dir_id * 16 AS seq, 'DIR' AS kind, path, dir_id FROM vdirs
    UNION ALL SELECT dir_id % 64, dir_id * 16 + line, 'FILE', name, dir_id FROM vfiles WHERE dir_id IN (SELECT dir_id FROM vdirs))"""


@query(with_views(
    _POSITIONAL + """ SELECT part, seq, kind, path, last_value(CASE WHEN kind = 'DIR' THEN path END IGNORE NULLS) OVER (PARTITION BY part ORDER BY seq) AS dir_path
    FROM p""", "vdirs", "vfiles"))  # fmt: skip
def forward_fill_parent(spark: SparkSession, sf: str) -> DataFrame:
    """A positional plan with the directory of each row."""
    dirs = catalog.dirs(spark, sf)
    own = dirs.select((F.col("dir_id") % 64).alias("part"), (F.col("dir_id") * 16).alias("seq"), F.lit("DIR").alias("kind"), "path")
    files = catalog.files(spark, sf).join(dirs.select("dir_id"), "dir_id", "left_semi")
    rows = own.unionByName(files.select((F.col("dir_id") % 64).alias("part"), (F.col("dir_id") * 16 + F.col("line")).alias("seq"), F.lit("FILE").alias("kind"), F.col("name").alias("path")))
    return ranking.fill_forward(rows, "part", "seq", F.when(F.col("kind") == "DIR", F.col("path")), "dir_path")


@query(with_views(
    """, f AS (SELECT dir_id % 4 AS fid, id, dir_id, row_number() OVER (PARTITION BY dir_id % 4 ORDER BY id) - 1 AS idx FROM vfiles),
    d AS (SELECT fid, dir_id, min(idx) AS first, count(*) AS n FROM f GROUP BY fid, dir_id)
    SELECT d.dir_id, f.id, f.fid, f.idx::BIGINT AS idx FROM d JOIN f ON f.fid = d.fid AND f.idx >= d.first AND f.idx < d.first + d.n""", "vfiles"))  # fmt: skip
def range_join_dir_files(spark: SparkSession, sf: str) -> DataFrame:
    files = catalog.files(spark, sf).select((F.col("dir_id") % 4).alias("fid"), "id", "dir_id")
    files = ranking.row_numbers(files, "fid", "id", "idx")
    dirs = files.groupBy("fid", "dir_id").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("files_count"))
    return control.dir_file_range(dirs, files.select("fid", "id", "idx")).select("dir_id", "id", "fid", "idx")


@query(with_views(
    """, b AS (SELECT id, unnest(range(0, greatest(size, 1), 1024)) AS "offset", size FROM vdocs)
    SELECT id, "offset", least(size - "offset", 1024)::BIGINT AS length, "offset" + least(size - "offset", 1024) >= size AS is_last FROM b""", "vdocs"))  # fmt: skip
def block_plan(spark: SparkSession, sf: str) -> DataFrame:
    return packing.blocks(catalog.docs(spark, sf).select("id", "size"), "size", 1024).select("id", "offset", "length", "is_last")


def _segments(files: DataFrame) -> DataFrame:
    rows = files.select("id", (F.col("line") % 4).alias("shard"), (F.col("size") + 60).alias("len"))
    out = packing.segment_rollover(rows, "shard", ["id"], "len", 300_000)
    return out.select("id", "shard", "segment", "offset", hashing.pack_locator(F.col("shard"), F.col("segment")).alias("file_id"))


@query(with_views(
    """, e AS (SELECT id, line % 4 AS shard, 60 + size AS len, row_number() OVER w AS rn, sum(60 + size) OVER w AS p FROM vfiles WINDOW w AS (PARTITION BY line % 4 ORDER BY id ROWS UNBOUNDED PRECEDING)),
    j AS (SELECT a.shard, a.rn, a.p - a.len AS base, greatest(coalesce(b.rn, 0), a.rn) + 1 AS nxt FROM (SELECT *, p - len + 300000 AS reach FROM e) a ASOF LEFT JOIN e b ON a.shard = b.shard AND a.reach >= b.p),
    RECURSIVE k AS (SELECT shard, rn, base, nxt, 0::BIGINT AS segment FROM j WHERE rn = 1
        UNION ALL SELECT j.shard, j.rn, j.base, j.nxt, k.segment + 1 FROM k JOIN j ON j.shard = k.shard AND j.rn = k.nxt)
    SELECT e.id, e.shard, k.segment, (e.p - e.len - k.base)::BIGINT AS "offset", e.shard * 65536 + k.segment AS file_id FROM e ASOF JOIN k ON e.shard = k.shard AND e.rn >= k.rn""", "vfiles"))  # fmt: skip
def segment_rollover(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(catalog.files(spark, sf))
