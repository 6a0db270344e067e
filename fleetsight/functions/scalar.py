"""Row expressions shared by the operators (all stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros(ts: Column) -> Column:
    """Timestamp to epoch microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def age_seconds(ts: Column, as_of: Column) -> Column:
    return (micros(as_of) - micros(ts)) / F.lit(1e6)


def instant(text: str) -> Column:
    """A literal point in time; operators take their clock as a parameter."""
    return F.lit(text).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def from_iso(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def clean_class(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def csv_text(items: Column) -> Column:
    return F.array_join(items, ",")


def csv_items(text: Column) -> Column:
    """Text list back to an array; blanks disappear."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x) != "")


def csv_longs(text: Column) -> Column:
    return F.transform(csv_items(text), lambda x: F.trim(x).cast("long"))


def sigmoid(x: Column) -> Column:
    clipped = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def human_bytes(n: Column) -> Column:
    """One decimal and the largest unit below 1024."""
    out = F.format_string("%.1f PB", n / F.lit(1024.0 ** 5))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        scaled = n / F.lit(1024.0 ** power)
        out = F.when(F.abs(scaled) < 1024, F.format_string(f"%.1f {unit}", scaled)).otherwise(out)
    return out


def human_latency(ms: Column) -> Column:
    return (F.when(ms < 1, F.format_string("%.1f us", ms * 1000.0))
            .when(ms < 1000, F.format_string("%.1f ms", ms.cast("double")))
            .otherwise(F.format_string("%.2f s", ms / 1000.0)))


def human_percent(p: Column) -> Column:
    return F.format_string("%.1f%%", p.cast("double"))


def clamp(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo, F.least(hi, x))
