"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEM = r"(?i)^\d{2}-.*-\d{6}_\d{4}\.mp3$"


def number(c: Column) -> Column:
    """A double, null where the value is not a number or NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def clock(seconds: Column) -> Column:
    """Minutes and seconds as m:ss."""
    s = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)


def fixed(x: Column, digits: int) -> Column:
    """A double with so many digits, rounded half to even on its binary value."""
    return F.call_function("format_number", x, F.lit("0" + "." * (digits > 0) + "0" * digits))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """Name of the parent folder, empty without one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def is_stem(name: Column) -> Column:
    """Whether a file is a track of a multitrack recording."""
    return name.rlike(STEM)


def tokens(name: Column) -> Column:
    """Distinct words of a take's name: lower case, over two letters, not only digits."""
    low = F.regexp_replace(F.lower(name), r"\.mp3", "")
    parts = F.split(F.regexp_replace(low, "[^a-z0-9áéíóúñ ]", " "), " ")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$")))


def decibels(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)))


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))


def tempo_ratio(a: Column, b: Column) -> Column:
    """a / b with halves and doubles counted as equal: the ratio nearest 1; 1 if a tempo is unknown."""
    candidates = F.transform(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), lambda m: F.struct(F.abs(a / (b * m) - 1).alias("off"), (a / (b * m)).alias("ratio")))
    return F.when((a > 0) & (b > 0), F.array_min(candidates).ratio).otherwise(1.0)


def tempo_distance(a: Column, b: Column) -> Column:
    """Distance of two tempos by the natural logarithm of their ratio, an octave apart costing 0.15; 1 if a tempo is unknown."""
    candidates = F.transform(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), lambda m: F.abs(F.log(a / (b * m))) + F.when(m == 1.0, 0.0).otherwise(0.15))
    return F.when((a > 0) & (b > 0), F.array_min(candidates)).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A vector scaled to length 1."""
    length = F.transform(F.array(a), lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9)))  # computed once
    return F.flatten(F.transform(F.arrays_zip(F.array(a).alias("v"), length.alias("n")), lambda z: F.transform(z.v, lambda x: x / z.n)))


def window_count(n: Column, hop: int, least: int) -> Column:
    """Hop-strided windows of a signal of n samples, the last with at least so many."""
    return F.when(n >= least, F.floor((n - least) / hop) + 1).otherwise(0).cast("long")


def quota(n: Column | int, share: float) -> Column:
    """A share of n, rounded half to even."""
    return F.bround(F.lit(n) * share if isinstance(n, int) else n * share).cast("int")


def compilation_key(filter_: Column, profile: Column, dynamic: Column) -> Column:
    """The name by which votes know a compilation: filter, profile and mode."""
    return F.concat_ws("_", filter_, profile, F.when(dynamic, "dinamico").otherwise("fijo"))


def utc(text: Column) -> Column:
    """An ISO 8601 instant, with Z or an offset, as a timestamp; UTC without one; null if it is none."""
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(zoned).try_cast("timestamp")


def from_epoch(seconds: Column) -> Column:
    """Seconds since 1970, UTC, as a timestamp."""
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))


def months_back(ts: Column, months: int) -> Column:
    """An instant so many months of 30 days before."""
    return ts - F.make_dt_interval(F.lit(30 * months))


def local_day(ts: Column, tz: str) -> Column:
    """The calendar day of an instant in a time zone."""
    return F.to_date(F.from_utc_timestamp(ts, tz))  # the session's time zone must be UTC


def month_folder(ts: Column) -> Column:
    """The month of an instant, as yyyy-MM."""
    return F.date_format(ts, "yyyy-MM")
