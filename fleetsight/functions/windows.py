"""Window helpers that do not put one hot key into one task.

A plain ``Window.partitionBy(camera)`` sends a camera's whole history to a single task.  The
helpers here cut each key into bounded chunks, work inside the chunks and carry only one
summary row per chunk across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetsight.session import materialize


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                  amount: Column, name: str) -> DataFrame:
    """Running sum of ``amount`` per key, in ``order``; ``chunk`` must be monotone in it."""
    keys = list(keys)
    d = df.withColumn("_chunk", chunk).withColumn("_amount", amount)
    totals = d.groupBy(*keys, "_chunk").agg(F.sum("_amount").alias("_total"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk",
                            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        d.withColumn("_inside", F.sum("_amount").over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_chunk", "_amount", "_inside", "_offset")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                name: str = "rn") -> DataFrame:
    """``row_number`` per key, in ``order``, computed chunk by chunk."""
    return running_total(df, keys, order, chunk, F.lit(1).cast("long"), name)


def overlapped(df: DataFrame, rn: str, size: int, before: int) -> DataFrame:
    """Cut numbered rows into chunks of ``size`` that also see the ``before`` rows ahead of them.

    Adds ``_part`` and ``_own``.  Evaluate a window over (keys, ``_part``) and keep the rows
    where ``_own`` holds: each frame then reaches back at most ``before`` rows, exactly.
    """
    own = F.floor(F.col(rn) / F.lit(size)).cast("long")
    after = F.floor((F.col(rn) + F.lit(before)) / F.lit(size)).cast("long")
    return (
        df.withColumn("_home", own)
        .withColumn("_part", F.explode(F.sequence(F.col("_home"), after)))
        .withColumn("_own", F.col("_part") == F.col("_home"))
        .drop("_home")
    )


def last_known(df: DataFrame, keys: Sequence[str], rn: str, size: int, value: str,
               name: str) -> DataFrame:
    """Last non-null ``value`` at or before each row, per key, over dense row numbers."""
    keys = list(keys)
    d = df.withColumn("_part", F.floor(F.col(rn) / F.lit(size)).cast("long"))
    tails = d.groupBy(*keys, "_part").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(rn))).alias("_tail"))
    across = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(*keys, "_part",
                           F.last("_tail", ignorenulls=True).over(across).alias("_carry"))
    inside = W.partitionBy(*keys, "_part").orderBy(rn).rowsBetween(W.unboundedPreceding, 0)
    return (
        d.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
        .join(carried, [*keys, "_part"], "left")
        .withColumn(name, F.coalesce("_in", "_carry"))
        .drop("_part", "_in", "_carry")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
           name: str = "rn") -> DataFrame:
    """First ``n`` rows per key; planned with a map-side group limit, so skew stays cheap."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     percents: dict[str, float], few: int = 10_000) -> DataFrame:
    """Exact nearest-rank percentiles (0-based rank ``floor(n * p / 100)``, at most the last row).

    No key is sorted or collected as a whole: a sketch with a bounded error brackets each rank, values
    are counted, everything below a bracket folds into one row, and where a bracket still holds more than ``few``
    distinct values, it is cut into bands of about equal size and the band of the rank is kept, until it is small.
    """
    keys = list(keys)
    error, slack = 10_000, 0.002
    ends = {n: (p / 100 - slack, p / 100 + slack) for n, p in percents.items()}
    asked = sorted({x for e in ends.values() for x in e if 0 < x < 1})
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.percentile_approx(
        value, F.array(*[F.lit(x) for x in asked]), F.lit(error)).alias("_q"))
    at = lambda x: F.get("_q", asked.index(x)) if 0 < x < 1 else F.lit(None).cast("double")
    wanted = F.array(*[
        F.struct(F.lit(n).alias("stat"), at(ends[n][0]).alias("lo"), at(ends[n][1]).alias("hi"),
                 F.least(F.floor(F.col("_n") * F.lit(float(p)) / 100.0), F.col("_n") - 1).alias("rank"))
        for n, p in percents.items()])
    brackets = sizes.filter("_n > 0").select(*keys, F.explode(wanted).alias("w")).select(*keys, "w.*")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    j = counted.join(brackets, keys).filter(F.col("hi").isNull() | (F.col("_v") <= F.col("hi")))
    below = F.coalesce(F.col("_v") < F.col("lo"), F.lit(False))
    folded = j.groupBy(*keys, "stat", "rank", F.when(~below, F.col("_v")).alias("_v")).agg(
        F.sum("_c").alias("_c"))
    w = W.partitionBy(*keys, "stat").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, 0)
    # A bracket spans so small a share of a key's rows that only long keys can have too many values in it.
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest * 2 * (slack + 1 / error) + 2 > few:
        folded = _narrowed(folded, [*keys, "stat"], few)
    hit = folded.withColumn("_end", F.sum("_c").over(w)).filter(
        F.col("_v").isNotNull() & (F.col("_end") > F.col("rank")))
    return hit.groupBy(*keys).agg(*[
        F.min(F.when(F.col("stat") == n, F.col("_v"))).alias(n) for n in percents])


def _narrowed(folded: DataFrame, keys: list[str], few: int, bands: int = 64) -> DataFrame:
    """Counted values (``_v``, ``_c``; a null value stands for all below) of which each key keeps the band that holds its
    ``rank``, until no key has more than ``few`` values.  What lies below is subtracted from the rank."""
    asked = F.array(*[F.lit(i / bands) for i in range(1, bands)])
    while True:
        folded = materialize(folded, "ranks")
        cuts = materialize(folded.groupBy(*keys).agg(F.count("_v").alias("_m"), F.percentile_approx(
            "_v", asked, F.lit(10_000)).alias("_q")).filter(F.col("_m") > few).drop("_m"), "bands")
        if cuts.isEmpty():
            return folded
        band = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_q", lambda x: x < F.col("_v"))))
        cut = folded.join(cuts, keys).withColumn("_band", band).drop("_q")
        sums = cut.groupBy(*keys, "rank", "_band").agg(F.sum("_c").alias("_n"))
        upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, 0))
        there = sums.withColumn("_end", upto).filter((F.col("_end") > F.col("rank")) & (F.col("_end") - F.col("_n") <= F.col("rank")))
        kept = cut.join(there.select(*keys, "_band", (F.col("_end") - F.col("_n")).alias("_less")), [*keys, "_band"])
        folded = folded.join(cuts.select(*keys), keys, "left_anti").unionByName(
            kept.withColumn("rank", F.col("rank") - F.col("_less")).select(*folded.columns))
