"""Column helpers. Everything here is a JVM-side expression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a UTC wall-clock timestamp."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def hours_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_HOUR))


def plus_hours(ts: Column | str, hours: int) -> Column:
    return as_col(ts) + F.expr(f"INTERVAL '{int(hours)}' HOUR")


def plus_minutes(ts: Column | str, minutes: int) -> Column:
    return as_col(ts) + F.expr(f"INTERVAL '{int(minutes)}' MINUTE")


def time_bucket(ts: Column | str, hours: int) -> Column:
    """Index of the fixed-width clock bucket that holds ``ts``."""
    return F.floor(micros(ts) / F.lit(hours * MICROS_PER_HOUR)).cast("long")


def parse_utc(text: Column | str) -> Column:
    """Lenient ISO parse to a UTC wall-clock timestamp; anything unreadable becomes NULL."""
    trimmed = F.trim(as_col(text).cast("string"))
    return F.coalesce(F.try_to_timestamp(trimmed), F.try_to_timestamp(trimmed, F.lit("yyyyMMdd"))).cast("timestamp_ntz")


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c), c)


def or_default(c: Column | str, default: float) -> Column:
    """Zero counts as absent, like NULL and NaN's absence rule for configuration numbers."""
    return F.coalesce(F.nullif(as_col(c).cast("double"), F.lit(0.0)), F.lit(float(default)))


def or_setting(value: float | None, default: float) -> float:
    """The same rule for a driver-side setting."""
    return float(value) if value else float(default)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def bounded(c: Column, low: float, high: float) -> Column:
    """``clip`` for values that are never NULL: the argument is evaluated once."""
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def compact(*items: Column) -> Column:
    """Array of the non-NULL items."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def tag_if(condition: Column, name: str | Column) -> Column:
    """``name`` when the condition holds, NULL otherwise (a NULL condition does not hold)."""
    return F.when(condition, name if isinstance(name, Column) else F.lit(name))


def sorted_unique(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))


def string_array(values: Iterable[str]) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def mean_of_present(parts: Sequence[Column]) -> Column:
    """Row mean over the non-NULL parts, NULL when all are NULL."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    n = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return F.when(n > 0, total / n)


def is_blank(c: Column | str) -> Column:
    """True for NULL and for text that trims to nothing."""
    return F.coalesce(F.trim(as_col(c).cast("string")) == "", F.lit(True))


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hex, built from ``sha2`` over the padded key."""
    raw = key.encode("utf-8")
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner_pad = bytes(b ^ 0x36 for b in raw).hex()
    outer_pad = bytes(b ^ 0x5C for b in raw).hex()
    inner = F.sha2(F.concat(F.unhex(F.lit(inner_pad)), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer_pad)), F.unhex(inner)), 256)


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)
