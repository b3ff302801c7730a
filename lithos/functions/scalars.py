"""Scalar functions as Column builders: retry delays, error classes, sizes, rates, times, rendering."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of an error text in the order in which they are tried.
ERROR_TOKENS = (
    "EPERM", "EACCES", "ENOENT", "ENOSPC", "EEXIST", "EIO", "ENOTDIR", "EISDIR", "EBUSY", "EROFS", "ETIMEDOUT", "ECONNRESET", "ECONNREFUSED",
    "NFS3ERR_JUKEBOX", "NFS3ERR_ACCES", "NFS3ERR_NOENT", "NFS3ERR_NOSPC", "NFS3ERR_IO", "OBJECT PATH NOT FOUND", "NETWORK NAME DELETED",
    "ACCESS DENIED", "PERMISSION DENIED", "NO SUCH FILE", "NO SPACE LEFT",
)
# Linux error numbers.
ERROR_NUMBERS = {
    1: "EPERM", 13: "EACCES", 2: "ENOENT", 28: "ENOSPC", 17: "EEXIST", 5: "EIO", 20: "ENOTDIR", 21: "EISDIR", 16: "EBUSY", 30: "EROFS",
    110: "ETIMEDOUT", 104: "ECONNRESET", 111: "ECONNREFUSED",
}
#: Seconds between 1601 and 1970.
FILETIME_EPOCH = 11_644_473_600


def classify_error(detail: Column) -> Column:
    """The first token, in order, that the upper-cased text contains; else UNKNOWN."""
    upper = F.upper(detail)
    hits = [F.when(F.contains(upper, F.lit(t)), t.replace(" ", "_")) for t in ERROR_TOKENS]
    return F.coalesce(*hits, F.lit("UNKNOWN"))


def classify_errno(code: Column) -> Column:
    known = [F.when(code == n, name) for n, name in ERROR_NUMBERS.items()]
    return F.coalesce(*known, F.concat(F.lit("ERRNO_"), code.cast("string")))


@dataclass(frozen=True)
class RetryPolicy:
    """Delays in milliseconds; a backoff below 1 counts as 1, the jitter ratio is kept within 0 and 1."""

    max_retries: int = 3
    delay_ms: float = 1000.0
    multiplier: float = 1.0
    max_delay_ms: float = 1000.0
    jitter: float = 0.0

    @property
    def max_attempts(self) -> int:
        return self.max_retries + 1

    def delay(self, attempt: Column) -> Column:
        """Milliseconds to wait after a failed attempt (from 1)."""
        grown = F.lit(self.delay_ms) * F.pow(F.lit(max(self.multiplier, 1.0)), attempt - 1)
        base = F.least(grown, F.lit(max(self.max_delay_ms, self.delay_ms)))
        # a 32-bit linear congruential step of the attempt number
        seed = (attempt.cast("long") * 1_103_515_245 + 12_345).bitwiseAND(F.lit(0xFFFFFFFF))
        unit = (seed % 10_000) / F.lit(10_000.0)
        return base * F.greatest(F.lit(0.0), 1 + (unit * 2 - 1) * min(max(self.jitter, 0.0), 1.0))


def _scaled(value: Column, units: tuple[tuple[int, str], ...], last: Column) -> Column:
    """value in the first unit (size, pattern) that it reaches; ties of the last digit go to the even one."""
    out = None
    for size, pattern in units:
        text = F.format_string(pattern, F.bround(value / F.lit(float(size)), 2))
        out = F.when(value >= size, text) if out is None else out.when(value >= size, text)
    return out.otherwise(last)


_BINARY = ((1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB"))


def format_bytes(n: Column, spaced: bool = True) -> Column:
    """Whole bytes below 1 KiB, else two decimals in KiB to GiB."""
    gap = " " if spaced else ""
    value = n.cast("double")
    return _scaled(value, tuple((size, f"%.2f{gap}{unit}") for size, unit in _BINARY), F.concat(n.cast("long").cast("string"), F.lit(f"{gap}B")))


def format_bytes_units(n: Column, units: tuple[str, ...]) -> Column:
    """Two decimals in the largest of units (powers of 1024) that the value reaches."""
    value = n.cast("double")
    steps = tuple((1 << (10 * k), f"%.2f {unit}") for k, unit in reversed(list(enumerate(units))) if k)
    return _scaled(value, steps, F.format_string(f"%.2f {units[0]}", value))


def format_duration(ms: Column) -> Column:
    """Milliseconds as s.mmm seconds, from a minute on with minutes."""
    ms = ms.cast("long")
    secs, rest = (ms / 1000).cast("long"), ms % 1000
    minutes = F.format_string("%dm %d.%03ds", (secs / 60).cast("long"), secs % 60, rest)
    return F.when(secs < 60, F.format_string("%d.%03ds", secs, rest)).otherwise(minutes)


def rate(value: Column, seconds: Column) -> Column:
    """value per second; without time, value itself."""
    return F.when(seconds > 0, value / seconds).otherwise(value.cast("double"))


def rate_floored(value: Column, seconds: Column) -> Column:
    """value per second, with at least a millisecond."""
    return value / F.greatest(seconds, F.lit(0.001))


def parse_size(text: Column) -> Column:
    """`1.5K` and the like in bytes; null if it is no size."""
    upper = F.upper(F.trim(text))
    number = F.nullif(F.regexp_extract(upper, r"^([0-9]+\.?[0-9]*|\.[0-9]+)", 1), F.lit(""))
    unit = F.trim(F.regexp_replace(upper, r"^[0-9.]+", ""))
    power = F.when(unit.isin("", "B"), 0)
    for k, letter in enumerate("KMGT", 1):
        power = power.when(unit.isin(letter, letter + "B"), k)
    valid = F.rlike(upper, F.lit(r"^[0-9]*\.?[0-9]*[^0-9.]*$"))
    return F.when(valid, F.floor(number.cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))


def filetime_to_unix(ticks: Column) -> Column:
    """100-nanosecond ticks since 1601 as unix seconds, not below 0; 0 stays 0."""
    return F.when(ticks == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.expr("0L"), F.floor(ticks / F.lit(10_000_000)).cast("long") - FILETIME_EPOCH))


def unix_to_filetime(seconds: Column) -> Column:
    return (seconds + FILETIME_EPOCH) * 10_000_000


def synthesize_mode(is_dir: Column, readonly: Column) -> Column:
    """A unix mode for an entry that has none."""
    file_mode = F.when(readonly, 0o100444).otherwise(0o100644)
    return F.when(is_dir, F.when(readonly, 0o040555).otherwise(0o040755)).otherwise(file_mode)


def xml_escape(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def hash_hex(h: Column) -> Column:
    """A 32-bit value as eight upper-case hex digits."""
    return F.lpad(F.hex(h), 8, "0")


def octal(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 8))


def clamp_copy_buffer(size: Column) -> Column:
    return F.least(F.greatest(size, F.lit(256 << 10)), F.lit(4 << 20))


def copy_task_limit(connections: Column, configured: Column, per_connection: int = 8, most: int = 32) -> Column:
    """Configured tasks within 1 and most, or per_connection for each connection."""
    own = F.least(F.greatest(configured, F.lit(1)), F.lit(most))
    return F.when(configured > 0, own).otherwise(F.least(F.greatest(connections, F.lit(1)) * per_connection, F.lit(most)))


def sparse_ranges(size: Column, blocks: Column) -> Column:
    """The trailing hole of a file whose blocks of 512 bytes do not cover its size; null if there is none."""
    stored = blocks * 512
    return F.when(size > stored, F.array(F.struct(stored.alias("off"), (size - stored).alias("len"))))


def pairs_to_map(text: Column) -> Column:
    """Lines of name=base64 as a map to binary; only the first `=` of a line counts."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.contains(s, F.lit("=")))
    return F.map_from_entries(
        F.transform(lines, lambda s: F.struct(F.regexp_extract(s, "^([^=]*)=", 1), F.unbase64(F.regexp_extract(s, "^[^=]*=(.*)$", 1))))
    )


def rfc3339(ts: Column) -> Column:
    """A timestamp in UTC as 2024-01-31T12:00:00Z."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fold_id(hexed: Column) -> Column:
    """A 128-bit id of 32 hex digits as a signed long: its two halves by exclusive or."""
    half = lambda at: F.conv(F.substring(hexed, at, 16), 16, -10).cast("long")
    return half(1).bitwiseXOR(half(17))
