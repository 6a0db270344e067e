"""Rows by rank without gathering the rows before them.

The rows of a rank are found by narrowing: a sketch cuts the values into bands, the bands are counted, and only those
that hold the wanted ranks are looked at again, until few rows are left.  Each round is one scan with a range
filter and sends a few numbers to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsight.functions.scalar import micros

SMALL = 100_000
BANDS = 64


def _valued(df: DataFrame, by: str, descending: bool) -> DataFrame:
    """Rows with a number to sort by; nulls come last when descending, else first."""
    kind = dict(df.dtypes)[by]
    value = micros(F.col(by)) if kind.startswith(("timestamp", "date")) else F.col(by)
    whole = kind.startswith(("timestamp", "date")) or kind in ("tinyint", "smallint", "int", "bigint")
    value = value.cast("long") if whole else value.cast("double")
    end = F.lit(2 ** 63 - 1 if descending else -2 ** 63).cast("long") if whole else F.lit(
        float("inf") if descending else float("-inf"))
    return df.withColumn("_v", F.coalesce(-value if descending else value, end))


def _narrow(d: DataFrame, first: int, last: int, small: int) -> tuple[DataFrame, int, object]:
    """Rows around the ranks ``first .. last - 1`` (from 0), how many rows lie before them, and below which value."""
    part, before, low = d, 0, None
    n = d.count()
    while n > small:
        asked = F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)])
        cuts = sorted(set(part.agg(F.percentile_approx("_v", asked, F.lit(10_000))).first()[0]))
        band = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda x: x < F.col("_v")))
        counts = {r["b"]: r["count"] for r in part.groupBy(band.alias("b")).count().collect()}
        start, kept = before, []
        for b in range(len(cuts) + 1):
            if start < last and start + counts.get(b, 0) > first:
                kept.append((b, start, counts.get(b, 0)))
            start += counts.get(b, 0)
        size = sum(k[2] for k in kept)
        if not kept or size == n:
            break
        if kept[0][0] > 0:
            low = cuts[kept[0][0] - 1]
            part = part.filter(F.col("_v") > low)
        if kept[-1][0] < len(cuts):
            part = part.filter(F.col("_v") <= cuts[kept[-1][0]])
        before, n = kept[0][1], size
    return part, before, low


def rank_slice(df: DataFrame, by: str, offset: int, limit: int, descending: bool = False, tie: str = "id",
               small: int = SMALL) -> DataFrame:
    """``limit`` rows from rank ``offset`` on, in order; equal values by ``tie``."""
    part, before, _ = _narrow(_valued(df, by, descending), offset, offset + limit, small)
    return part.orderBy("_v", tie).offset(offset - before).limit(limit).drop("_v")


def lowest(df: DataFrame, by: str, k: int, tie: str = "id", small: int = SMALL) -> DataFrame:
    """The ``k`` rows of lowest rank, in no order; only the rows of the last band are sorted."""
    d = _valued(df, by, False)
    part, before, low = _narrow(d, k - 1, k, small)
    rest = part.orderBy("_v", tie).limit(max(0, k - before))
    return (rest if low is None else d.filter(F.col("_v") <= low).unionByName(rest)).drop("_v")
