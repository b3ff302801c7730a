"""Queries over paths: scans, filters, normalisation, mapping, hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos import catalog
from lithos.catalog import with_views
from lithos.functions import hashing, paths
from lithos.operators.filters import PathFilter, entry_kind, path_segments, segment_matches, visible, within_depth
from lithos.queries import query
from lithos.session import spread

_SEGS = "list_filter(string_split(path, '/'), lambda x: x <> '')"


@query(with_views(
    """SELECT split_part(path, '/', 3) AS root, count(DISTINCT d.dir_id)::BIGINT AS n_dirs, count(f.name)::BIGINT AS n_files,
        coalesce(sum(f.size), 0)::BIGINT AS bytes FROM vdirs d LEFT JOIN vfiles f ON f.dir_id = d.dir_id GROUP BY 1""", "vdirs", "vfiles"))  # fmt: skip
def scan_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Directories, files and bytes of each root; files are added up per directory first."""
    per_dir = catalog.files(spark, sf).groupBy("dir_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    rows = catalog.dirs(spark, sf).join(per_dir, "dir_id", "left")
    return rows.groupBy(F.element_at(F.split("path", "/"), 3).alias("root")).agg(
        F.count(F.lit(1)).alias("n_dirs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )


@query(with_views(
    f""", s AS (SELECT *, {_SEGS} AS g FROM vurls)
    SELECT id, path FROM s WHERE NOT (len(g) >= 2 AND starts_with(g[2], 'en') AND ends_with(g[2], 'en'))
        AND NOT (len(g) >= 1 AND g[1] LIKE 'm.%')""", "vurls"))  # fmt: skip
def filter_exclude_dir(spark: SparkSession, sf: str) -> DataFrame:
    chosen = PathFilter(exclude_dirs=["/*/en", "/m.*"])
    return catalog.urls(spark, sf).filter(chosen.emit_file(F.col("path"))).select("id", "path")


@query(with_views(
    f""", s AS (SELECT *, {_SEGS} AS g FROM vurls)
    SELECT id, path,
        (len(g) = 3 AND g[1] LIKE 'blog.%' AND g[3] LIKE '%1%' OR len(g) >= 2 AND starts_with(g[2], 'fr') AND ends_with(g[2], 'fr'))
            AND NOT (len(g) = 3 AND g[3] LIKE '%.html') AS emit_file,
        len(g) < 3 AND coalesce(g[1] LIKE 'blog.%', true) OR coalesce(starts_with(g[2], 'fr') AND ends_with(g[2], 'fr'), true) AS emit_dir
    FROM s""", "vurls"))  # fmt: skip
def filter_include_file(spark: SparkSession, sf: str) -> DataFrame:
    chosen = PathFilter(include_dirs=["/*/fr"], include_files=["/blog.*/*/*1*"], exclude_files=["/*/*/*.html"])
    p = F.col("path")
    return catalog.urls(spark, sf).select("id", "path", chosen.emit_file(p).alias("emit_file"), chosen.emit_dir(p).alias("emit_dir"))


@query("""
    SELECT p_partkey AS id, w AS word, starts_with(w, 'r') AND ends_with(w, 'r') AS literal, w LIKE 's%l%' AS starred, w LIKE '%e%t' AS inner_star,
        w LIKE '%' AS any_word
    FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)""")
def filter_segment_literal(spark: SparkSession, sf: str) -> DataFrame:
    words = catalog.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("word"))
    w = F.col("word")
    return words.select(
        "id", "word", segment_matches(w, "r").alias("literal"), segment_matches(w, "s*l*").alias("starred"),
        segment_matches(w, "*e*t").alias("inner_star"), segment_matches(w, "*").alias("any_word"),
    )


@query(with_views(
    """, e AS (SELECT id, CASE WHEN id % 5 = 0 THEN '.' || split_part(path, '/', 2) ELSE split_part(path, '/', 2) END AS name,
        CASE id % 4 WHEN 0 THEN 40960 WHEN 1 THEN 16877 WHEN 2 THEN 33188 ELSE 24576 END AS mode FROM vurls)
    SELECT id, name, CASE mode & 61440 WHEN 40960 THEN 'symlink' WHEN 16384 THEN 'dir' WHEN 32768 THEN 'file' WHEN 24576 THEN 'block' ELSE 'special' END AS kind
    FROM e WHERE name NOT LIKE '.%' AND name <> 'spam-farm.example.org' AND mode & 61440 <> 24576""", "vurls"))  # fmt: skip
def filter_hidden_skip_kind(spark: SparkSession, sf: str) -> DataFrame:
    host = F.element_at(F.split("path", "/"), 2)
    mode = F.when(F.col("id") % 4 == 0, 0xA000).when(F.col("id") % 4 == 1, 16877).when(F.col("id") % 4 == 2, 33188).otherwise(0x6000)
    rows = catalog.urls(spark, sf).select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("."), host)).otherwise(host).alias("name"), mode.alias("mode"))
    kept = rows.filter(visible(F.col("name"), skip_names=["spam-farm.example.org"])).withColumn("kind", entry_kind(F.col("mode")))
    return kept.filter("kind <> 'block'").select("id", "name", "kind")


@query(with_views(f"SELECT id, path, len({_SEGS})::INTEGER AS depth FROM vurls WHERE len({_SEGS}) <= 3", "vurls"))
def depth_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.urls(spark, sf).select("id", "path", F.size(path_segments(F.col("path"))).alias("depth"))
    return rows.filter(within_depth(F.col("depth"), 3))


_RAW = "replace(path, '/', CASE id % 4 WHEN 0 THEN '/' WHEN 1 THEN '//' WHEN 2 THEN '/./' ELSE '/x/../' END) || CASE id % 3 WHEN 0 THEN '/..' WHEN 1 THEN '/' ELSE '' END"


@query(with_views(
    f""", r AS (SELECT id, {_RAW} AS raw FROM vurls),
    p AS (SELECT id, raw, list_filter(string_split(replace(raw, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.') AS g FROM r),
    q AS (SELECT id, raw, '/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(g, lambda x: [x])),
        lambda acc, x: CASE WHEN x[1] = '..' THEN acc[:len(acc) - 1] ELSE list_concat(acc, x) END), '/') AS path FROM p)
    SELECT id, raw, path, path = '/blog.tionsh.example.net' OR starts_with(path, '/blog.tionsh.example.net/') AS below FROM q""", "vurls"))  # fmt: skip
def normalize_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.urls(spark, sf).select("id", F.expr(_RAW).alias("raw")).withColumn("path", paths.normalize(F.col("raw")))
    return rows.withColumn("below", paths.starts_with_path(F.lit("/blog.tionsh.example.net"), F.col("path")))


@query(with_views(
    f"""SELECT id, path, path[2:] AS native, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent,
        string_split(path, '/')[-1] AS name, NOT contains(path[2:], '/') AS is_root, trim(path, '/') AS relative,
        CASE WHEN starts_with(path, '/blog.tionsh.example.net/') THEN path[26:] END AS stripped
    FROM (SELECT id, '/' || array_to_string({_SEGS}, '/') AS path FROM vurls)""", "vurls"))  # fmt: skip
def path_pieces(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return catalog.urls(spark, sf).select("id", paths.normalize(p).alias("path")).select(
        "id", "path", paths.logical_to_native(p).alias("native"), paths.parent(p).alias("parent"), paths.file_name(p).alias("name"),
        paths.is_root_entry(p).alias("is_root"), paths.relative(p).alias("relative"), paths.strip_base(p, "/blog.tionsh.example.net").alias("stripped"),
    )


@query(with_views(
    """, r AS (SELECT dir_id, path, path[2:] AS rel, CASE WHEN starts_with(path, '/ds/') THEN path[5:] ELSE path[2:] END AS own FROM vdirs)
    SELECT dir_id, '/src/' || own AS local_source, own AS remote_source, 'COPY/D_REPO/' || rel AS logical_target, 'COPY/D_REPO/' || own AS remote_target,
        'P/' || rel AS target_rel, '/restore/' || rel AS logical_phase, '/restore/' || own AS native_phase, path AS requested
    FROM r""", "vdirs"))  # fmt: skip
def path_mapping_layouts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return catalog.dirs(spark, sf).select(
        "dir_id",
        paths.layout_path(p, "local_source", "/src", "/ds").alias("local_source"),
        paths.layout_path(p, "remote_source", "", "/ds").alias("remote_source"),
        paths.layout_path(p, "prefixed_logical_target", "COPY/D_REPO", "/ds").alias("logical_target"),
        paths.layout_path(p, "prefixed_remote_relative_target", "COPY/D_REPO", "/ds").alias("remote_target"),
        paths.target_relative(p, "/export/ds", "P").alias("target_rel"),
        paths.to_target(p, "/mnt/source", "/restore", logical=True).alias("logical_phase"),
        paths.to_target(p, "/ds", "/restore", logical=False).alias("native_phase"),
        paths.requested_to_logical(paths.strip_root(p, "/ds"), "/opt/dataset", "/ds").alias("requested"),
    )


@query(with_views(
    """, h AS (SELECT id, checksum, sha256('{"path":"' || path || '","size":' || size || '}') AS d FROM vdocs)
    SELECT id, checksum, ('0x' || d[7:8] || d[5:6] || d[3:4] || d[1:2])::BIGINT AS hash32 FROM h""", "vdocs"))  # fmt: skip
def meta_hash32(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.docs(spark, sf).select("id", "checksum", hashing.metadata_hash("path", "size").alias("hash32"))


def _fnv_sql(text: str, basis: int) -> str:
    # ASCII text only
    return (
        f"list_reduce(list_prepend({basis}::HUGEINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::HUGEINT)),"
        " lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    )


@query(with_views(
    f""", s AS (SELECT dir_id, ({_fnv_sql('path', hashing.PLAN_BASIS)} % 16)::BIGINT AS shard FROM vdirs)
    SELECT shard, count(*)::BIGINT AS entries, min(dir_id)::BIGINT AS first_dir, max(dir_id)::BIGINT AS last_dir FROM s GROUP BY shard""", "vdirs"))  # fmt: skip
def fnv_shard_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(catalog.dirs(spark, sf).select("dir_id", "path")).select("dir_id", hashing.plan_shard(F.col("path"), 16).alias("shard"))
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("entries"), F.min("dir_id").alias("first_dir"), F.max("dir_id").alias("last_dir"))


@query(with_views(f"SELECT id, path, ({_fnv_sql('path', hashing.BLOB_BASIS)} % 16)::BIGINT AS shard FROM vdocs", "vdocs"))
def fnv_shard_blob(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.docs(spark, sf).select("id", "path", hashing.blob_shard(F.col("path"), 16).alias("shard"))


@query(with_views(
    """, r AS (SELECT id, line, 60 + length(name) AS len, line % 4 AS shard FROM vfiles),
    w AS (SELECT id, shard, sum(len) OVER (PARTITION BY shard, id // 512 ORDER BY id) - len AS off,
        row_number() OVER (PARTITION BY shard, id // 512 ORDER BY id) - 1 AS idx, id // 512 AS seg FROM r)
    SELECT id, (shard * 65536 + seg % 65536)::BIGINT AS file_id, off::BIGINT AS "offset", idx::BIGINT AS idx, shard::BIGINT AS shard, (seg % 65536)::BIGINT AS segment
    FROM w""", "vfiles"))  # fmt: skip
def locator_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Locators of rows in the segments of four writers: file id, byte offset, index."""
    rows = catalog.files(spark, sf).select(
        "id", (F.length("name") + 60).alias("len"), (F.col("line") % 4).alias("shard"), F.floor(F.col("id") / 512).cast("long").alias("seg")
    )
    own = Window.partitionBy("shard", "seg").orderBy("id")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(
        "id", hashing.pack_locator(F.col("shard"), F.col("seg") % 65536).alias("file_id"),
        F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long").alias("offset"), (F.row_number().over(own) - 1).cast("long").alias("idx"),
    )
    return out.select("*", hashing.locator_shard(F.col("file_id")).alias("shard"), hashing.locator_segment(F.col("file_id")).alias("segment"))


@query("""
    SELECT page_id AS id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
        regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS export,
        CASE page_id % 5 WHEN 0 THEN 'NFS' WHEN 1 THEN 'SMB' WHEN 2 THEN 'SMB' ELSE 'Local' END AS kind,
        regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS nfs_host,
        nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '/') AS nfs_export, (page_id % 7)::BIGINT AS nfs_uid,
        string_split(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/')[1] AS smb_share, page_id % 3 = 0 AS smb_password
    FROM pages""")
def url_parse(spark: SparkSession, sf: str) -> DataFrame:
    pages = catalog.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = pages.withColumn("nfs", paths.nfs_location(F.concat(F.lit("nfs://"), bare, F.lit("?sub=a/b&uid="), (F.col("id") % 7).cast("string"))))
    rows = rows.withColumn("smb", paths.smb_location(F.concat(F.lit("smb://"), bare, F.lit("?username=u"), F.when(F.col("id") % 3 == 0, "&password=p").otherwise("&password="))))
    scheme = F.get(F.array(*map(F.lit, ("nfs://", "smb://", "smb:\\\\", "file://", "/"))), (F.col("id") % 5).cast("int"))
    return rows.select(
        "id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", "^[a-z]+://[^/?#]+(/[^?#]*)", 1).alias("export"), paths.location_kind(F.concat(scheme, bare)).alias("kind"),
        F.col("nfs.host").alias("nfs_host"), F.col("nfs.export").alias("nfs_export"), F.col("nfs.uid").alias("nfs_uid"),
        F.col("smb.share").alias("smb_share"), F.col("smb.has_password").alias("smb_password"),
    )
