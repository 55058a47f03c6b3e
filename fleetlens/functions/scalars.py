"""Scalar column helpers. All return native Column expressions: no Python UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comm prefixes that the point writer folds into one series, in match order
# (first match wins).
COMM_PREFIXES = ["StreamT", "IPC", "FSBroker", "gvfsd", "gsd", "kworker", "glfs", "gnome",
                 "ibus", "ksoftirqd", "swapper"]

MIB = 1048576.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_int(x, default: int | None = 0) -> Column:
    """Loose integer: ints pass, floats truncate, numeric text parses, garbage -> default.

    Input may be a string column (loose JSON) or any numeric column.
    """
    s = _c(x).cast("string")
    v = F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))
    return v if default is None else F.coalesce(v, F.lit(default).cast("bigint"))


def safe_float(x, default: float | None = 0.0) -> Column:
    v = _c(x).cast("string").try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def map_uid(uid, loose: bool = False) -> Column:
    """0 -> 0 (root), 1..999 -> 1 (system users), others unchanged, missing -> -1.

    ``loose=True`` also parses text uids (unparsable -> -1); typed integer columns skip
    the text round trip."""
    u = safe_int(uid, -1) if loose else F.coalesce(_c(uid).cast("bigint"), F.lit(-1).cast("bigint"))
    return F.when(u == 0, F.lit(0).cast("bigint")).when((u > 0) & (u < 1000), F.lit(1).cast("bigint")).otherwise(u)


def first_prefix(x, prefixes: Sequence[str]) -> Column:
    """The first prefix in list order that ``x`` starts with, else null."""
    c = _c(x)
    if not prefixes:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(c.startswith(p), F.lit(p)) for p in prefixes])


def longest_prefix(x, prefixes: Sequence[str]) -> Column:
    """The longest matching prefix; ties keep the earlier list entry."""
    ordered = sorted(prefixes, key=len, reverse=True)  # stable: ties keep list order
    return first_prefix(x, ordered)


def normalize_comm(comm, prefixes: Sequence[str] = COMM_PREFIXES) -> Column:
    """Empty/null -> 'unknown'; a listed prefix replaces the name; else unchanged."""
    c = _c(comm)
    return F.when(c.isNull() | (c == ""), F.lit("unknown")).otherwise(
        F.coalesce(first_prefix(c, prefixes), c))


def tag_or(x, default: str) -> Column:
    """Null or empty tag -> default text."""
    return F.coalesce(F.nullif(_c(x).cast("string"), F.lit("")), F.lit(default))


def spread(x) -> Column:
    """max - min of a column inside a group."""
    return F.max(_c(x)) - F.min(_c(x))


def to_mib(x) -> Column:
    return _c(x) / F.lit(MIB)


def memory_percent(total, available) -> Column:
    """round(100 * (total - available) / total, 2); total == 0 -> 0."""
    t, a = _c(total), _c(available)
    return F.when(t == 0, F.lit(0.0)).otherwise(
        F.round((F.lit(100.0) * (t - a) / t).cast("decimal(38,10)"), 2).cast("double"))


def stable(x, scale: int = 9) -> Column:
    """A floating average or ratio fixed at ``scale`` decimals (through decimal, like the
    SQL side): sums of doubles depend on the order of addition, so the stored value is
    made independent of partitioning and engine."""
    return _c(x).cast(f"decimal(38,{scale})").cast("double")


def round_half_up(x, scale: int) -> Column:
    """Rounding that agrees across engines at exact ties: go through decimal first."""
    return F.round(_c(x).cast("decimal(38,12)"), scale).cast("double")


def local_bucket(ts, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """Wall-clock label of a UTC instant in ``zone`` (as timestamp_ntz)."""
    return F.from_utc_timestamp(_c(ts), zone).cast("timestamp_ntz")


def status_map(status) -> Column:
    """Live config status -> dashboard status: running -> active, stopped -> down, else idle."""
    s = _c(status)
    return F.when(s == "running", F.lit("active")).when(s == "stopped", F.lit("down")).otherwise(F.lit("idle"))


def cluster_health(active, total) -> Column:
    """Share of active nodes: >= 0.9 Healthy, >= 0.6 Degraded, else Critical (0 nodes -> Critical)."""
    r = F.try_divide(_c(active).cast("double"), _c(total).cast("double"))
    return (F.when(r.isNull() | (_c(total) == 0), F.lit("Critical"))
             .when(r >= 0.9, F.lit("Healthy"))
             .when(r >= 0.6, F.lit("Degraded"))
             .otherwise(F.lit("Critical")))


def age_text(ts, as_of) -> Column:
    """'Ns ago' / 'Nm ago' / 'Nh ago' / 'Nd ago' with floor, relative to ``as_of``."""
    secs = F.floor((F.unix_micros(_c(as_of)) - F.unix_micros(_c(ts))) / F.lit(1000000)).cast("bigint")
    return (F.when(secs < 60, F.concat(secs.cast("string"), F.lit("s ago")))
             .when(secs < 3600, F.concat(F.floor(secs / 60).cast("string"), F.lit("m ago")))
             .when(secs < 86400, F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago")))
             .otherwise(F.concat(F.floor(secs / 86400).cast("string"), F.lit("d ago"))))


def hash_fraction(key) -> Column:
    """Deterministic bucket in [0, 10000) from md5 of the key (same in DuckDB)."""
    return F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 10000
