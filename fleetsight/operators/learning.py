"""Accuracy, sampling priorities and training exports from review feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsight.functions.scalar import micros
from fleetsight.functions.windows import latest

HOUR = 3_600_000_000
# Minimum and maximum examples per class, alert level and window.
MIN_EXAMPLES, MAX_EXAMPLES = 10, 1000
ALERT_BELOW, WINDOW_HOURS = 0.7, 24


def in_window(fb: DataFrame, as_of: Column, hours: float = WINDOW_HOURS) -> DataFrame:
    age = micros(as_of) - micros(F.col("timestamp"))
    return fb.filter((age >= 0) & (age <= F.lit(int(hours * HOUR))))


def filter_feedback(fb: DataFrame, since: Column | None = None, class_name: str | None = None,
                    corrections: bool = False) -> DataFrame:
    d = fb
    if since is not None:
        d = d.filter(F.col("timestamp") >= since)
    if class_name:
        d = d.filter(F.col("corrected_class") == class_name)
    if corrections:
        d = d.filter(~F.col("was_correct"))
    return d


def overall(fb: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("was_correct")
    return fb.agg(n.alias("total_reviewed"), ok.alias("correct"), (n - ok).alias("incorrect"),
                  F.when(n > 0, ok / n).otherwise(0.0).alias("accuracy"))


def rate_by(fb: DataFrame, class_col: str, name: str) -> DataFrame:
    """Share of right answers per predicted (precision) or actual (recall) class."""
    return fb.groupBy(F.col(class_col).alias("class_name")).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if("was_correct") / F.count(F.lit(1))).alias(name))


def confusion(fb: DataFrame) -> DataFrame:
    return fb.groupBy(F.col("corrected_class").alias("actual"),
                      F.col("original_class").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def worst_classes(fb: DataFrame, n: int = 5, min_samples: int = 5) -> DataFrame:
    return (rate_by(fb, "original_class", "accuracy").filter(F.col("n") >= min_samples)
            .orderBy("accuracy", "class_name").limit(n).select("class_name", "accuracy"))


def most_confused(fb: DataFrame, n: int = 5) -> DataFrame:
    return (confusion(fb).filter(F.col("actual") != F.col("predicted"))
            .orderBy(F.desc("n"), "actual", "predicted").limit(n))


def alert(fb: DataFrame, as_of: Column, hours: float = WINDOW_HOURS,
          below: float = ALERT_BELOW) -> DataFrame:
    """Empty windows count as accuracy 0 and therefore alert."""
    return overall(in_window(fb, as_of, hours)).select(
        "total_reviewed", "accuracy", (F.col("accuracy") < below).alias("alert"))


def hourly_accuracy(fb: DataFrame, hours: int = WINDOW_HOURS, below: float = ALERT_BELOW) -> DataFrame:
    """Accuracy of the trailing window as seen at every full hour.

    Rows are first folded to one per hour; only those summaries are repeated for the windows
    they fall into, so no window ever holds the raw rows.
    """
    # A row counts for every full hour h with h - hours <= ts <= h; ts on the hour counts at both ends.
    t = micros(F.col("timestamp"))
    first = F.ceil(t / F.lit(HOUR)).cast("long")
    last = F.floor((t + F.lit(hours * HOUR)) / F.lit(HOUR)).cast("long")
    folded = fb.groupBy(first.alias("a"), last.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("was_correct").alias("ok"))
    spread = folded.withColumn("hour", F.explode(F.sequence("a", "b")))
    return spread.groupBy("hour").agg(
        F.sum("n").alias("total_reviewed"), F.sum("ok").alias("correct")).select(
        "hour", "total_reviewed", "correct",
        (F.col("correct") / F.col("total_reviewed")).alias("accuracy"),
        (F.col("correct") / F.col("total_reviewed") < below).alias("alert"))


def report(fb: DataFrame, as_of: Column) -> DataFrame:
    """One row: all-time and recent accuracy, alert, worst class and worst confusion."""
    recent = alert(fb, as_of)
    worst = worst_classes(fb, 1)
    pair = most_confused(fb, 1)
    return overall(fb).select(
        "*", recent.select("accuracy").scalar().alias("recent_accuracy"),
        recent.select("alert").scalar().alias("alert"),
        worst.select("class_name").scalar().alias("worst_class"),
        pair.select("actual").scalar().alias("confused_actual"),
        pair.select("predicted").scalar().alias("confused_predicted"),
        pair.select("n").scalar().alias("confused_n"))


def to_examples(fb: DataFrame) -> DataFrame:
    return fb.filter(F.coalesce("image_path", F.lit("")) != "").select(
        "feedback_id", "image_path", F.col("corrected_class").alias("label"),
        F.lit(1.0).alias("confidence"), F.lit("human_review").alias("source"), "attributes")


def class_distribution(examples: DataFrame) -> DataFrame:
    return examples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def balance(examples: DataFrame, min_examples: int = MIN_EXAMPLES,
            max_examples: int = MAX_EXAMPLES, seed: str = "0", key: str = "feedback_id") -> DataFrame:
    """Every kept class ends with the same number of examples.

    The hash order picks the same rows on every attempt.  At most ``max_examples`` rows per class
    survive the map-side limit, so the size of the largest class does not matter; a class
    smaller than the target is kept whole and repeated in turn.
    """
    counts = class_distribution(examples)
    target = counts.agg(F.least(F.max("n"), F.lit(max_examples).cast("long")).alias("t"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    kept = latest(examples.withColumn("_h", order), ["label"], [F.asc("_h"), F.asc(key)],
                  max_examples, "_rn")
    sized = (kept.join(counts.filter(F.col("n") >= min_examples), "label")
             .withColumn("_target", target.scalar()))
    whole = F.least(F.col("n"), F.lit(max_examples).cast("long"))
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_target") - 1) / whole).cast("long"))
    return (sized.withColumn("copy", F.explode(turns))
            .filter(F.col("copy") * whole + F.col("_rn") <= F.col("_target"))
            .drop("_h", "_rn", "n", "_target"))


def priorities(candidates: DataFrame, fb: DataFrame, min_examples: int = MIN_EXAMPLES) -> DataFrame:
    """Uncertainty, plus a bonus for rare and for badly recognised classes."""
    rare = fb.groupBy(F.col("corrected_class").alias("primary_class")).agg(
        F.count(F.lit(1)).alias("_seen"))
    worst = worst_classes(fb).select(F.col("class_name").alias("primary_class"),
                                     F.lit(0.3).alias("_worst"))
    j = candidates.join(rare, "primary_class", "left").join(worst, "primary_class", "left")
    bonus = F.when(F.coalesce("_seen", F.lit(0)) < min_examples, 0.5).otherwise(0.0)
    return j.withColumn("priority", (1.0 - F.col("confidence")) + bonus
                        + F.coalesce("_worst", F.lit(0.0))).drop("_seen", "_worst")


def suggest(objects: DataFrame, fb: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most useful of all objects that need review."""
    pool = objects.filter(F.col("classification_status") == "needs_review")
    return (priorities(pool, fb).orderBy(F.desc("priority"), F.asc("id")).limit(n)
            .select("id", "primary_class", "confidence", "priority"))
