"""Path functions as Column builders: logical paths, mappings between layouts, locations.

A logical path starts with a slash, has no empty, `.` or `..` segments and no
backslashes. Everything here is built of JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_logical(p: Column) -> Column:
    """Backslashes to slashes."""
    return F.replace(p, F.lit("\\"), F.lit("/"))


def segments(p: Column) -> Column:
    """The non-empty segments of a path, `.` dropped and `..` resolved (a `..` too many is ignored)."""
    parts = F.filter(F.split(to_logical(p), "/"), lambda s: (s != "") & (s != "."))
    plain = ~F.exists(parts, lambda s: s == "..")
    popped = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)),
    )
    return F.when(plain, parts).otherwise(popped)


def normalize(p: Column) -> Column:
    """The logical form of a path."""
    return F.concat(F.lit("/"), F.array_join(segments(p), "/"))


def join(base: Column, name: Column) -> Column:
    """A logical directory and one name below it."""
    return normalize(F.concat(base, F.lit("/"), name))


def logical_to_native(p: Column) -> Column:
    """`/D/x` to `D:/x` for a one-letter first segment that is followed by another, else the path without its first slash."""
    logical = normalize(p)
    drive = F.regexp_extract(logical, "^/([A-Za-z])/", 1)
    return F.when(drive != "", F.concat(drive, F.lit(":"), F.substring(logical, 3, 1 << 30))).otherwise(F.substring(logical, 2, 1 << 30))


def starts_with_path(prefix: Column, p: Column) -> Column:
    """Whether p is prefix or lies below it, at segment borders; `/` holds everything."""
    return (prefix == "/") | (p == prefix) | F.startswith(p, F.concat(prefix, F.lit("/")))


def is_ancestor(directory: Column, p: Column) -> Column:
    """Whether p lies below directory."""
    return (directory == "/") | F.startswith(p, F.concat(directory, F.lit("/")))


def ancestors(p: Column) -> Column:
    """A logical path, all directories above it and `/`, as an array: turns a prefix join into an equi-join."""
    parts = F.split(p, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.array_distinct(above)


def relative(p: Column) -> Column:
    """Backslashes turned, slashes at both ends dropped."""
    return F.trim(to_logical(p), F.lit("/"))


def join_relative(base: Column, child: Column) -> Column:
    name = relative(child)
    return F.when(base == "", name).when(name == "", base).otherwise(F.concat(base, F.lit("/"), name))


def is_root_entry(p: Column) -> Column:
    return ~F.contains(F.substring(normalize(p), 2, 1 << 30), F.lit("/"))


def parent(p: Column) -> Column:
    """The directory of a relative or logical path; empty if there is none."""
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def file_name(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def strip_base(p: Column, base: str) -> Column:
    """p below base without it; null if it is not below."""
    return F.when(F.startswith(p, F.lit(base.rstrip("/") + "/")), F.substring(p, len(base.rstrip("/")) + 2, 1 << 30))


def strip_root(p: Column, root: str) -> Column:
    """A logical path as a relative one, without the logical root if it lies below that."""
    rel, top = F.ltrim(p, F.lit("/")), root.strip("/")
    if not top:
        return rel
    return F.when(rel == top, F.lit("")).when(F.startswith(rel, F.lit(top + "/")), F.substring(rel, len(top) + 2, 1 << 30)).otherwise(rel)


def prefixed(prefix: str, rel: Column) -> Column:
    base = prefix.rstrip("/")
    return F.when(rel == "", F.lit(base)).otherwise(F.concat(F.lit(base + "/"), rel))


def physical_to_logical(p: Column, base: str, root: str, normal: bool = True) -> Column:
    """A physical path seen from base: already-logical paths (below root, not below base) stay.

    normal=False gives the plan side, which does not resolve `.` and `..`.
    """
    base_path, root_path = F.lit(base.rstrip("/") or "/"), F.lit(root.rstrip("/") or "/")
    below = starts_with_path(base_path, p)
    rel = F.when(below, F.substring(p, len(base.rstrip("/")) + 1, 1 << 30)).otherwise(p)
    stripped = F.concat(F.lit("/"), F.ltrim(rel, F.lit("/")))
    kept = ~below & starts_with_path(root_path, p)
    return F.when(kept, normalize(p) if normal else p).otherwise(normalize(stripped) if normal else stripped)


def requested_to_logical(p: Column, base: str, root: str) -> Column:
    """A user's request as a logical path: below base it is physical, else it is put below the logical root."""
    plain = normalize(p)
    if root == "/":
        inside = plain
    else:
        inside = F.when(starts_with_path(F.lit(root), plain), plain).otherwise(normalize(F.concat(F.lit(root.rstrip("/")), plain)))
    return F.when(starts_with_path(F.lit(base.rstrip("/") or "/"), p), physical_to_logical(p, base, root)).otherwise(inside)


def target_relative(p: Column, base: str, prefix: str) -> Column:
    """Where a path goes below a remote target's prefix: below base the rest; if the first segment is base's name all; else the name."""
    own = base.rstrip("/").rsplit("/", 1)[-1]
    bare = F.ltrim(p, F.lit("/"))
    rest = F.when(starts_with_path(F.lit(base.rstrip("/") or "/"), p), F.ltrim(F.substring(p, len(base.rstrip("/")) + 1, 1 << 30), F.lit("/")))
    rel = F.coalesce(rest, F.when(F.element_at(F.split(bare, "/"), 1) == own, bare), file_name(p))
    return relative(F.concat(F.lit(prefix + "/"), rel) if prefix else rel)


def to_target(p: Column, source: str, target: str, logical: bool) -> Column:
    """Where a metadata path goes below target: logical paths whole, native ones without the source prefix."""
    path, base = normalize(p), "/" + source.strip("/")
    whole = F.ltrim(path, F.lit("/"))
    if logical:
        rel = whole
    else:  # the prefix is compared as text, without a border
        rest = F.ltrim(F.substring(path, len(base) + 1, 1 << 30), F.lit("/"))
        rel = F.when(F.startswith(path, F.lit(base)) & (rest != ""), rest).otherwise(whole)
    return F.concat(F.lit(target.rstrip("/") + "/"), rel)


def layout_path(p: Column, layout: str, prefix: str, root: str) -> Column:
    """A plan path in one of the four layouts of source and target."""
    if layout == "local_source":
        return prefixed(prefix, strip_root(p, root))
    if layout == "remote_source":
        return strip_root(p, root)
    if layout == "prefixed_logical_target":
        return prefixed(prefix, F.ltrim(p, F.lit("/")))
    if layout == "prefixed_remote_relative_target":
        return prefixed(prefix, strip_root(p, root))
    raise ValueError(layout)


def location_kind(spec: Column) -> Column:
    return (
        F.when(F.startswith(spec, F.lit("nfs://")), "NFS")
        .when(F.startswith(spec, F.lit("smb://")) | F.startswith(spec, F.lit("smb:\\\\")), "SMB")
        .otherwise("Local")
    )


def nfs_location(spec: Column) -> Column:
    """nfs://host[:port]/export[?sub=&uid=&gid=] as a struct; null if it is not one (an export `/` is none)."""
    authority = F.regexp_extract(spec, "^nfs://([^/]+)/", 1)
    port = F.regexp_extract(authority, ":([0-9]{1,5})$", 1)
    export = F.regexp_extract(spec, "^nfs://[^/]+(/[^?]*)", 1)
    query = lambda key: F.regexp_extract(spec, rf"[?&]{key}=([^&]*)", 1)
    number = lambda key: F.coalesce(F.nullif(query(key), F.lit("")).cast("long"), F.lit(0))
    return F.when(
        (authority != "") & (export != "") & (export != "/"),
        F.struct(
            F.regexp_replace(authority, ":[0-9]{1,5}$", "").alias("host"), F.nullif(port, F.lit("")).cast("int").alias("port"), export.alias("export"),
            query("sub").alias("sub_path"), number("uid").alias("uid"), number("gid").alias("gid"),
        ),
    )


def smb_location(spec: Column) -> Column:
    r"""smb://host[:port]/share[/sub][?username=&password=], or smb:\\host\share..., as a struct; null if it is not one."""
    rest = F.regexp_replace(F.replace(spec, F.lit("\\"), F.lit("/")), "^smb://", "")
    authority = F.regexp_extract(rest, "^([^/?]+)/", 1)
    parts = F.filter(F.split(F.regexp_extract(rest, "^[^/?]+/([^?]*)", 1), "/"), lambda s: s != "")
    query = lambda key: F.nullif(F.regexp_extract(rest, rf"[?&]{key}=([^&?]*)", 1), F.lit(""))
    return F.when(
        (location_kind(spec) == "SMB") & (authority != "") & (F.size(parts) > 0),
        F.struct(
            F.regexp_replace(authority, ":[0-9]{1,5}$", "").alias("host"),
            F.nullif(F.regexp_extract(authority, ":([0-9]{1,5})$", 1), F.lit("")).cast("int").alias("port"),
            F.get(parts, F.lit(0)).alias("share"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), "/").alias("sub_path"),
            query("username").alias("username"), query("password").isNotNull().alias("has_password"),
        ),
    )


def display_location(spec: Column) -> Column:
    """A location for logs and manifests: without port, user ids and credentials."""
    nfs, smb = nfs_location(spec), smb_location(spec)
    below = lambda c: F.when(c == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.ltrim(c, F.lit("/"))))
    return F.coalesce(
        F.concat(F.lit("nfs://"), nfs["host"], nfs["export"], below(nfs["sub_path"])),
        F.concat(F.lit("smb://"), smb["host"], F.lit("/"), smb["share"], below(smb["sub_path"])),
        spec,
    )


def last_components(p: Column, n: int) -> Column:
    """The last n segments of a path, fewer if it has fewer."""
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n, F.lit(0)) + 1, n), "/")


def source_layout(spec: Column) -> Column:
    """struct<base, root> of a source: a local path is its own base below the root /; of a remote one the last segment is the root, what is above it the base."""
    parts = F.when(location_kind(spec) == "Local", F.array().cast("array<string>")).otherwise(
        F.filter(F.split(F.regexp_replace(F.regexp_replace(spec, "^[a-z]+://[^/?]+", ""), "[?].*$", ""), "/"), lambda s: s != "")
    )
    above = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    local = F.struct(spec.alias("base"), F.lit("/").alias("root"))
    remote = F.struct(above.alias("base"), F.concat(F.lit("/"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))).alias("root"))
    return F.when(location_kind(spec) == "Local", local).otherwise(remote)
