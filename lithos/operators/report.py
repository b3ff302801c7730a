"""Statistics and reports over plans, tasks, events and inspected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The components a backup copy must have.
REQUIRED_COMPONENTS = (("manifest.json", "file"), ("D_REPO", "dir"), ("M_REPO/meta", "dir"), ("C_REPO/ctrl", "dir"))


def peak_concurrency(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Most spans of a key that are open at once; a span that ends as another starts is closed first.

    Starts and ends are first counted by instant, so a window holds instants, not spans.
    """
    ticks = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("t"))
    moves = ticks.groupBy(key, F.col("t.at").alias("at")).agg(
        F.sum(F.when(F.col("t.d") < 0, 1).otherwise(0)).alias("ended"), F.sum(F.when(F.col("t.d") > 0, 1).otherwise(0)).alias("started")
    )
    running = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # a span of no length opens and closes at one instant and is never open beside a later one
    return moves.withColumn("open", F.sum(F.col("started") - F.col("ended")).over(running)).groupBy(key).agg(F.max("open").alias("peak"))


def longest_prefix(items: DataFrame, routes: DataFrame, text: str) -> DataFrame:
    """Each item with the longest route prefix that its text starts with; null if there is none.

    Prefixes are joined by value: a text is exploded to its beginnings of the lengths that routes have (only those lengths
    come to the driver, at most as many as the longest route has characters).
    """
    lengths = [r[0] for r in routes.select(F.length("prefix")).distinct().collect()]
    starts = F.array(*[F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    keyed = items.withColumn("__p", F.explode_outer(F.array_compact(starts)))
    hits = keyed.join(routes.select(F.col("prefix").alias("__p"), "route"), "__p", "left")
    best = F.max_by(F.col("route"), F.when(F.col("route").isNotNull(), F.length("__p")))
    return hits.groupBy(*items.columns).agg(best.alias("route"))


def inspect_union(*kinds: DataFrame) -> DataFrame:
    """Records of several kinds in one table; columns that a kind lacks are null."""
    out = kinds[0]
    for df in kinds[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def group_records(records: DataFrame) -> DataFrame:
    """Records (kind, type, fields map) by kind and type: their number, their columns in order, and the widest value."""
    return records.groupBy("kind", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("fields"))))), ",").alias("columns"),
        F.max(F.array_max(F.transform(F.map_values("fields"), lambda v: F.length(v)))).alias("width"),
    )


def missing_components(copies: DataFrame, present: DataFrame) -> DataFrame:
    """Required components that a copy lacks: copy_id, component, component_kind."""
    parts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in REQUIRED_COMPONENTS])
    wanted = copies.withColumn("c", F.explode(parts)).select("copy_id", F.col("c.n").alias("component"), F.col("c.k").alias("component_kind"))
    return wanted.join(present.select("copy_id", "component", "component_kind"), ["copy_id", "component", "component_kind"], "left_anti")


def column_widths(records: DataFrame) -> DataFrame:
    """Records (kind, type, fields map) by kind, type and column: how many have it, and how wide it is, its name included."""
    each = records.select("kind", "type", F.explode("fields").alias("column", "value"))
    rows = each.groupBy("kind", "type", "column").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("value")).alias("w"))
    return rows.select("kind", "type", "column", "n", F.greatest(F.length("column"), F.coalesce("w", F.lit(0))).alias("width"))


def clean(value: Column) -> Column:
    """A value for tab-separated output: tabs and line ends become spaces, null nothing."""
    return F.coalesce(F.regexp_replace(value, "[\\t\\r\\n]", " "), F.lit(""))


def as_lines(records: DataFrame, columns: list[str], fmt: str) -> DataFrame:
    """Records (kind, type, fields map) as lines of text: json (one object a record), csv or tab (the given columns)."""
    if fmt == "json":
        line = F.to_json(F.struct("kind", "type", "fields"))
    else:
        cells = [F.coalesce(F.try_element_at(F.col("fields"), F.lit(c)), F.lit("")) for c in columns]
        if fmt == "csv":
            line = F.to_csv(F.struct("kind", "type", *[c.alias(f"c{k}") for k, c in enumerate(cells)]))
        elif fmt == "tab":
            line = F.concat_ws("\t", clean(F.col("kind")), clean(F.col("type")), *map(clean, cells))
        else:
            raise ValueError(fmt)
    return records.select(line.alias("line"))


def as_table(records: DataFrame, widths: DataFrame, columns: list[str]) -> DataFrame:
    """Records as lines of padded cells; widths: rows (column, width), one for each of columns."""
    wide = widths.filter(F.col("column").isin(*columns)).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("column", "width"))).alias("w"))
    cell = lambda c: F.expr(f"rpad(coalesce(try_element_at(fields, '{c}'), ''), coalesce(try_element_at(w, '{c}'), 0), ' ')")
    return records.join(wide).select(F.rtrim(F.concat_ws("  ", *map(cell, columns))).alias("line"))
