"""Queries over restore requests, policies, plans with metadata, and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos import catalog
from lithos.catalog import with_views
from lithos.functions import hashing
from lithos.functions.paths import location_kind, normalize
from lithos.operators import ranking, report, restore
from lithos.plans import control
from lithos.queries import query

# requests: directories, files and names that are not there
_REQUESTS = """, req AS (SELECT DISTINCT raw, '/' || array_to_string(list_filter(string_split(raw, '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM (
        SELECT dir || '/' AS raw FROM vdocs WHERE id % 97 = 0 UNION ALL SELECT '/.' || path FROM vdocs WHERE id % 31 = 0
        UNION ALL SELECT path || 'x' FROM vdocs WHERE id % 89 = 0)),
    dd AS (SELECT DISTINCT dir AS path FROM vdocs),
    res AS (SELECT req.raw, req.path, CASE WHEN dd.path IS NOT NULL THEN 'dir' WHEN v.path IS NOT NULL THEN 'file' END AS kind
        FROM req LEFT JOIN dd ON dd.path = req.path LEFT JOIN vdocs v ON v.path = req.path)"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id")
    raw = F.array(
        F.when(n % 97 == 0, F.concat("dir", F.lit("/"))), F.when(n % 31 == 0, F.concat(F.lit("/."), "path")), F.when(n % 89 == 0, F.concat("path", F.lit("x")))
    )
    each = catalog.docs(spark, sf).select(F.explode(F.array_compact(raw)).alias("raw"))
    return each.distinct().select("raw", normalize(F.col("raw")).alias("path"))


def _dirs(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.docs(spark, sf).select(F.col("dir").alias("path")).distinct()


@query(with_views(_REQUESTS + " SELECT raw, path, kind FROM res WHERE kind IS NOT NULL", "vdocs"))
def resolved_semi(spark: SparkSession, sf: str) -> DataFrame:
    return control.resolve(_requests(spark, sf), _dirs(spark, sf), catalog.docs(spark, sf)).filter("kind IS NOT NULL")


@query(with_views(_REQUESTS + " SELECT path, raw FROM res WHERE kind IS NULL", "vdocs"))
def unresolved_requests(spark: SparkSession, sf: str) -> DataFrame:
    return control.unresolved(_requests(spark, sf), _dirs(spark, sf), catalog.docs(spark, sf))


@query(with_views(_REQUESTS + " SELECT count(*)::BIGINT AS n, coalesce(string_agg(raw, ', ' ORDER BY raw), '') AS message FROM res WHERE kind IS NULL", "vdocs"))
def unresolved_message(spark: SparkSession, sf: str) -> DataFrame:
    return control.unresolved_message(control.unresolved(_requests(spark, sf), _dirs(spark, sf), catalog.docs(spark, sf)))


@query(with_views(
    _REQUESTS + """ SELECT 'FILE' AS kind, path FROM vdocs v WHERE EXISTS (SELECT 1 FROM res WHERE kind = 'file' AND res.path = v.path
            OR kind = 'dir' AND (res.path = '/' OR res.path = v.path OR starts_with(v.path, res.path || '/')))
    UNION ALL SELECT 'DIR', path FROM dd WHERE EXISTS (SELECT 1 FROM res WHERE kind = 'dir' AND (res.path = '/' OR res.path = dd.path OR starts_with(dd.path, res.path || '/'))
            OR kind = 'file' AND starts_with(res.path, dd.path || '/'))""", "vdocs"))  # fmt: skip
def fine_grain_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Files and directories that a list of requests selects."""
    docs, dirs = catalog.docs(spark, sf).select("path", "dir"), _dirs(spark, sf)
    named = control.resolve(_requests(spark, sf), dirs, docs)
    return control.fine_grain(named, dirs, docs)


@query(with_views(
    """, cat AS (SELECT id, name, size, line % 4 AS meta_fid, id * 80 AS meta_offset FROM vfiles),
    plan AS (SELECT line % 4 AS meta_fid, id * 80 AS meta_offset, dir_id, CASE WHEN id % 3 = 0 THEN 'New' ELSE 'DataModified' END AS diff FROM vfiles WHERE id % 4 <> 0
        UNION ALL SELECT 9, id, dir_id, 'New' FROM vfiles WHERE id % 100 = 0)
    SELECT p.dir_id, c.id, c.name, c.size, p.diff FROM plan p JOIN cat c ON c.meta_fid = p.meta_fid AND c.meta_offset = p.meta_offset""", "vfiles"))  # fmt: skip
def plan_metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    files = catalog.files(spark, sf)
    place = [(F.col("line") % 4).alias("meta_fid"), (F.col("id") * 80).alias("meta_offset")]
    plan = files.filter("id % 4 <> 0").select(*place, "dir_id", F.when(F.col("id") % 3 == 0, "New").otherwise("DataModified").alias("diff"))
    lost = files.filter("id % 100 = 0").select(F.lit(9).cast("long").alias("meta_fid"), F.col("id").alias("meta_offset"), "dir_id", F.lit("New").alias("diff"))
    found = control.with_metadata(plan.unionByName(lost), files.select(*place, "id", "name", "size"))
    return found.select("dir_id", "id", "name", "size", "diff")


@query(with_views("SELECT path, 493::BIGINT AS mode, NULL::BIGINT AS uid, NULL::BIGINT AS gid, mtime AS atime, mtime, CASE WHEN dir_id % 9 = 0 THEN 'skip_missing' ELSE 'set' END AS action FROM vdirs", "vdirs"))
def mtime_plan(spark: SparkSession, sf: str) -> DataFrame:
    dirs = catalog.dirs(spark, sf)
    number = F.element_at(F.split("path", "/"), -1).cast("long")
    return control.mtime_plan(dirs).withColumn("action", restore.mtime_action(number % 9 != 0))


@query(with_views(
    """, j AS (SELECT c.dir_id, c.name, c.mtime AS s, p.mtime AS t, p.dir_id IS NOT NULL AS there FROM curr_files c LEFT JOIN prev_files p ON p.dir_id = c.dir_id AND p.name = c.name)
    SELECT dir_id, name, policy, CASE policy WHEN 'replace' THEN true WHEN 'skip' THEN NOT there
        ELSE CASE WHEN NOT there THEN true WHEN t % 13 = 0 THEN true WHEN s % 11 = 0 THEN false ELSE s > t END END AS should
    FROM j, (SELECT unnest(['replace', 'skip', 'keep_newer']) AS policy)""", "curr_files", "prev_files"))  # fmt: skip
def restore_policy(spark: SparkSession, sf: str) -> DataFrame:
    """What each policy restores; some times are unknown."""
    source = catalog.curr_files(spark, sf).select("dir_id", "name", F.when(F.col("mtime") % 11 != 0, F.col("mtime")).alias("s"))
    target = catalog.prev_files(spark, sf).select("dir_id", "name", F.when(F.col("mtime") % 13 != 0, F.col("mtime")).alias("t"), F.lit(True).alias("there"))
    both = source.join(target, ["dir_id", "name"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    rows = both.withColumn("policy", F.explode(F.array(*map(F.lit, ("replace", "skip", "keep_newer")))))
    return rows.select("dir_id", "name", "policy", restore.should_restore(F.col("policy"), F.col("s"), F.col("there"), F.col("t")).alias("should"))


@query(with_views(
    """, n AS (SELECT id, CASE id % 5 WHEN 0 THEN 'copy' WHEN 1 THEN 'hardlink' WHEN 2 THEN 'delete' WHEN 3 THEN 'mtime' ELSE 'other' END AS phrase FROM vurls),
    c AS (SELECT id, phrase || '_' || sha256(phrase || ':' || id)[1:16] || CASE WHEN id % 7 = 0 THEN '.bin' ELSE '.control.bin' END AS name FROM n)
    SELECT id, name, kind, list_position(['copy', 'hardlink', 'delete', 'mtime'], kind)::INTEGER AS phase,
        row_number() OVER (PARTITION BY kind ORDER BY name)::BIGINT AS rank
    FROM (SELECT id, name, CASE WHEN name LIKE '%.control.bin' AND split_part(name, '_', 1) <> 'other' THEN split_part(name, '_', 1) END AS kind FROM c) WHERE kind IS NOT NULL""", "vurls"))  # fmt: skip
def phase_order(spark: SparkSession, sf: str) -> DataFrame:
    phrases = F.array(*map(F.lit, ("copy", "hardlink", "delete", "mtime", "other")))
    phrase = F.get(phrases, (F.col("id") % 5).cast("int"))
    whole = hashing.control_name(phrase, F.col("id").cast("string"))
    name = F.when(F.col("id") % 7 == 0, F.replace(whole, F.lit(".control.bin"), F.lit(".bin"))).otherwise(whole)
    rows = catalog.urls(spark, sf).select("id", name.alias("name")).withColumn("kind", hashing.control_kind(F.col("name"))).filter("kind IS NOT NULL")
    return ranking.ranks(rows.withColumn("phase", restore.phase_rank(F.col("kind"))), ["kind"], F.col("name"), "rank")


@query(with_views(
    """, n AS (SELECT CASE id % 5 WHEN 0 THEN 'copy' WHEN 1 THEN 'hardlink' WHEN 2 THEN 'delete' WHEN 3 THEN 'mtime' ELSE 'other' END AS kind, id FROM vurls)
    SELECT kind, min(kind || '_' || sha256(kind || ':' || id)[1:16] || '.control.bin') AS name FROM n WHERE kind <> 'other' GROUP BY kind""", "vurls"))  # fmt: skip
def first_control_files(spark: SparkSession, sf: str) -> DataFrame:
    phrases = F.array(*map(F.lit, ("copy", "hardlink", "delete", "mtime", "other")))
    phrase = F.get(phrases, (F.col("id") % 5).cast("int"))
    return restore.first_of_phases(catalog.urls(spark, sf).select(hashing.control_name(phrase, F.col("id").cast("string")).alias("name")))


@query("""
    SELECT s.k AS source, t.k AS target, CASE WHEN s.k = 'Local' AND t.k = 'Local' THEN 'blocking' ELSE 'async' END AS pipeline,
        lower(s.k) || '_to_' || lower(t.k) AS route, s.k = 'Local' AS valid_copy_source
    FROM (SELECT unnest(['Local', 'NFS', 'SMB']) AS k) s, (SELECT unnest(['Local', 'NFS', 'SMB']) AS k) t""")
def dispatch_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Which pipeline serves each pair of locations; a restore takes only local copies."""
    from lithos.plans.dispatch import dispatch

    specs = spark.createDataFrame([("/data",), ("nfs://h/export",), ("smb://h/share",)], "spec string").select(location_kind(F.col("spec")).alias("kind"))
    return dispatch(specs, specs)


@query("""
    SELECT c.copy_id, w.component, w.component_kind FROM (SELECT DISTINCT conv_id AS copy_id FROM conversations) c,
        (VALUES ('manifest.json', 'file', 0), ('D_REPO', 'dir', 1), ('M_REPO/meta', 'dir', 2), ('C_REPO/ctrl', 'dir', 3)) w(component, component_kind, n)
    WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.copy_id AND x.turn % 4 = w.n)""")
def prereq_missing_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components that a copy lacks; a conversation's turns stand for what is there."""
    turns = catalog.table(spark, sf, "conversations").select(F.col("conv_id").alias("copy_id"), (F.col("turn") % 4).cast("int").alias("n"))
    part = F.get(F.array(*[F.struct(F.lit(n).alias("c"), F.lit(k).alias("k")) for n, k in report.REQUIRED_COMPONENTS]), F.col("n"))
    present = turns.select("copy_id", part.alias("p")).select("copy_id", F.col("p.c").alias("component"), F.col("p.k").alias("component_kind"))
    return report.missing_components(turns.select("copy_id").distinct(), present)


@query(with_views(
    """SELECT path, CASE WHEN id % 2 = 0 THEN 'Dir' ELSE 'File' END AS entry_type, CASE WHEN id % 7 = 0 THEN 'skip_missing'
        WHEN (id % 2 = 0) <> (id % 3 = 0) THEN 'skip_kind' WHEN id % 2 = 0 THEN 'remove_dir' ELSE 'remove_file' END AS delete_action,
        CASE WHEN id % 5 = 0 AND id % 2 = 1 THEN 'skip_symlink' WHEN id % 5 = 0 THEN 'symlink' ELSE 'copy' END AS copy_action FROM vdocs""", "vdocs"))  # fmt: skip
def side_effect_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What delete and copy phases would do at their targets."""
    n = F.col("id")
    kind = F.when(n % 2 == 0, "Dir").otherwise("File")
    return catalog.docs(spark, sf).select(
        "path", kind.alias("entry_type"), restore.delete_action(kind, n % 7 != 0, n % 3 == 0).alias("delete_action"),
        restore.copy_action(n % 5 == 0, n % 2 == 1).alias("copy_action"),
    )
