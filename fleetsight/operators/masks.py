"""Segmentation masks as long pixel tables and as packed 64-pixel words.

A word row is (frame_key, mask_id, v, w, bits): bit ``u % 64`` of word ``u // 64``.  Intersections
become ``bit_count(a & b)`` over equi-joined words, which moves a small fraction of the rows a
pixel join would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetsight.functions.scalar import micros
from fleetsight.operators.graph import greedy_removed
from fleetsight.session import checkpoint

# Agreement and claim limits, and area band.
AGREE_IOU, BOOST, PENALTY = 0.3, 0.1, 0.05
OVERLAP, CLAIMED = 0.3, 0.5
MIN_AREA, MAX_AREA = 500, 500_000
SOURCES = ("fastsam", "depth", "pointcloud")


def words(pixels: DataFrame, ids: tuple[str, ...] = ("frame_key", "mask_id")) -> DataFrame:
    bit = F.expr("shiftleft(1L, u % 64)")
    return pixels.groupBy(*ids, "v", F.floor(F.col("u") / 64).cast("int").alias("w")).agg(
        F.bit_or(bit).alias("bits"))


def unpack(packed: DataFrame) -> DataFrame:
    """Word rows back to pixel rows."""
    cols = [c for c in packed.columns if c not in ("w", "bits")]
    return packed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter(
        F.expr("getbit(bits, _i)") == 1).select(*cols, (F.col("w") * 64 + F.col("_i")).alias("u"))


def shape(pixels: DataFrame, ids: tuple[str, ...] = ("frame_key", "mask_id")) -> DataFrame:
    """Area and inclusive bounding box."""
    return pixels.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("area"), F.min("u").alias("bx1"), F.min("v").alias("by1"),
        F.max("u").alias("bx2"), F.max("v").alias("by2"))


def areas(packed: DataFrame, ids: tuple[str, ...] = ("frame_key", "mask_id")) -> DataFrame:
    return packed.groupBy(*ids).agg(F.sum(F.bit_count("bits")).alias("area"))


def overlaps(packed: DataFrame, area: DataFrame) -> DataFrame:
    """Overlapping masks of a frame, each pair once: intersection, IoU and share of the smaller.

    Only masks that share a word meet, and the counts combine before the shuffle.
    """
    a = packed.select("frame_key", "v", "w", F.col("mask_id").alias("a"), F.col("bits").alias("_p"))
    b = packed.select("frame_key", "v", "w", F.col("mask_id").alias("b"), F.col("bits").alias("_q"))
    both = F.bit_count(F.col("_p").bitwiseAND(F.col("_q")))
    inter = (a.join(b, ["frame_key", "v", "w"]).filter("a < b AND (_p & _q) <> 0")
             .groupBy("frame_key", "a", "b").agg(F.sum(both).alias("intersection")))
    size = lambda c: area.select("frame_key", F.col("mask_id").alias(c), F.col("area").alias(f"area_{c}"))
    j = inter.join(size("a"), ["frame_key", "a"]).join(size("b"), ["frame_key", "b"])
    i = F.col("intersection")
    return j.withColumn("iou", i / (F.col("area_a") + F.col("area_b") - i)).withColumn(
        "overlap", i / F.least("area_a", "area_b"))


def matching(pairs: DataFrame, threshold: float) -> DataFrame:
    """Partners of each mask with at least ``threshold`` IoU, both directions."""
    p = pairs.filter(F.col("iou") >= threshold)
    return p.select("frame_key", F.col("a").alias("mask_id"), F.col("b").alias("match_id"), "iou") \
        .unionByName(p.select("frame_key", F.col("b").alias("mask_id"),
                              F.col("a").alias("match_id"), "iou"))


def depth_stats(mask_pixels: DataFrame, pixels: DataFrame) -> DataFrame:
    """Median and spread of the valid depth under each mask.

    Medians run on whole millimetres: a mask has at most 65,536 distinct values, however large.
    """
    d = pixels.filter(F.col("depth_raw") > 0).select("frame_key", "v", "u", "depth_raw")
    j = mask_pixels.join(d, ["frame_key", "v", "u"])
    return j.groupBy("frame_key", "mask_id").agg(
        (F.median("depth_raw") / 1000).alias("median_m"),
        (F.stddev_pop("depth_raw") / 1000).alias("std_m"), F.count(F.lit(1)).alias("valid_px"))


def crop(mask_pixels: DataFrame, pixels: DataFrame, channel: str = "g") -> DataFrame:
    """Every pixel of a mask's bounding box, with zero outside the mask."""
    box = shape(mask_pixels)
    grid = (box.withColumn("v", F.explode(F.sequence("by1", "by2")))
            .withColumn("u", F.explode(F.sequence("bx1", "bx2")))
            .select("frame_key", "mask_id", "v", "u"))
    inside = mask_pixels.join(pixels.select("frame_key", "v", "u", channel),
                              ["frame_key", "v", "u"])
    return grid.join(inside, ["frame_key", "mask_id", "v", "u"], "left").withColumn(
        channel, F.coalesce(channel, F.lit(0)))


# --- claims ---------------------------------------------------------------------------------

def live_claims(log: DataFrame) -> DataFrame:
    """Claims in force: the last event of each mask, unless it released the mask."""
    cols = [c for c in log.columns if c != "mask_id"]
    g = log.groupBy("mask_id").agg(
        F.max_by(F.struct(*cols), F.struct("ts", "step")).alias("e"))
    return g.select("mask_id", *[F.col(f"e.{c}").alias(c) for c in cols]).filter(
        F.col("action") != "release")


def claim_age(claims: DataFrame, as_of: Column, stale_s: float = 0.5, expire_s: float = 1.0) -> DataFrame:
    age = (micros(as_of) - micros(F.col("ts"))) / 1e6
    return claims.withColumn("age_s", age).withColumn(
        "claim_state", F.when(age > expire_s, "expired").when(age > stale_s, "stale")
        .otherwise("live"))


def _meet(masks: DataFrame, claims: DataFrame, stale_us: int) -> DataFrame:
    """Word rows of masks next to the word rows of claims of the same scene that are not stale.

    Both sides fall into time buckets as long as a claim lives, so a mask meets only the claims of
    its own and the previous bucket.  A claim with a column ``until`` ends there.
    """
    bucket = lambda c: F.floor(micros(F.col(c)) / F.lit(stale_us)).cast("long")
    m = masks.withColumn("_t", micros(F.col("ts"))).withColumn("_b", bucket("ts"))
    c = claims.select("scene", "v", "w", F.col("mask_id").alias("claim_id"),
                      F.col("object_id").alias("claim_object"), F.col("bits").alias("claim_bits"),
                      micros(F.col("ts")).alias("_ct"), bucket("ts").alias("_cb"),
                      *([micros(F.col("until")).alias("_until")] if "until" in claims.columns else []))
    c = c.withColumn("_b", F.explode(F.array(F.col("_cb"), F.col("_cb") + 1)))
    # Dealt by scene and bucket, all words that a mask and a claim share meet in one partition.
    j = m.repartition("scene", "_b").join(c.repartition("scene", "_b"), ["scene", "_b", "v", "w"])
    age = F.col("_t") - F.col("_ct")
    if "until" in claims.columns:
        j = j.filter(F.col("_until").isNull() | (F.col("_t") < F.col("_until")))
    return j.filter((age >= 0) & (age <= stale_us) & (F.col("claim_object") != F.col("object_id")))


def claim_overlaps(masks: DataFrame, claims: DataFrame, stale_us: int,
                   at_least: float = OVERLAP) -> DataFrame:
    """Share of the smaller area a mask has in common with live claims of other objects."""
    met = _meet(masks, claims, stale_us).filter("(bits & claim_bits) <> 0")
    pair = ["mask_id", "claim_id", "claim_object"]
    inter = (met.groupBy("scene", "_b", *pair).agg(
        F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("claim_bits")))).alias("n"))
        .groupBy(*pair).agg(F.sum("n").alias("n")))
    size = areas(masks, ("mask_id",))
    claim_size = areas(claims, ("mask_id",)).select(
        F.col("mask_id").alias("claim_id"), F.col("area").alias("claim_area"))
    j = inter.filter("n > 0").join(size, "mask_id").join(claim_size, "claim_id")
    return j.withColumn("overlap", F.col("n") / F.least("area", "claim_area")).filter(
        F.col("overlap") >= at_least)


def unclaimed(masks: DataFrame, hits: DataFrame, limit: float = CLAIMED) -> DataFrame:
    taken = hits.filter(F.col("overlap") >= limit).select("mask_id").distinct()
    return masks.join(taken, "mask_id", "left_anti")


def subtract_claims(masks: DataFrame, claims: DataFrame, stale_us: int) -> DataFrame:
    """Word rows of the masks without the pixels of live claims of other objects."""
    taken = _meet(masks, claims, stale_us).groupBy("mask_id", "v", "w").agg(
        F.bit_or("claim_bits").alias("_taken"))
    left = F.expr("bits & ~coalesce(_taken, 0L)")
    return masks.join(taken, ["mask_id", "v", "w"], "left").withColumn("bits", left).drop(
        "_taken").filter("bits <> 0")


def live_at_last(claims: DataFrame, stale_us: int, by: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Claims that are not stale when the last claim of their scene is made."""
    last = claims.groupBy(*by).agg(F.max("ts").alias("_last"))
    return claims.join(last, list(by)).filter(
        micros(F.col("_last")) - micros(F.col("ts")) <= stale_us).drop("_last")


def composite(claims: DataFrame, by: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Claimed area per scene: the union of its claims."""
    merged = claims.groupBy(*by, "v", "w").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bit_count("bits")).alias("claimed_area"))


def track_claims(tracked: DataFrame) -> DataFrame:
    """Claims of tracked objects: an object's newest mask replaces the one before it.

    ``tracked(scene, object_id, mask_id, ts)``, one row per mask, to the same with ``until``.
    """
    one = tracked.groupBy("scene", "object_id", "ts").agg(F.max("mask_id").alias("mask_id"))
    w = W.partitionBy("scene", "object_id").orderBy("ts")
    return one.withColumn("until", F.lead("ts").over(w))


def manage(masks: DataFrame, packed: DataFrame, mask_pixels: DataFrame, tracked: DataFrame, stale_us: int,
           min_area: int = MIN_AREA) -> DataFrame:
    """Masks of a frame that no live claim of a tracked object covers, without conflicts among them.

    ``masks(frame_key, mask_id, scene, ts, priority, confidence)``; ``packed`` are the word rows of new
    and tracked masks, ``tracked`` as in ``track_claims``.
    """
    word = packed.select("mask_id", "v", "w", "bits")
    claims = word.join(track_claims(tracked), "mask_id")
    new = word.join(masks.select("mask_id", "scene", "ts"), "mask_id").withColumn("object_id", F.lit(""))
    free = unclaimed(masks, claim_overlaps(new, claims, stale_us))
    ids = ["frame_key", "mask_id"]
    return resolve(free.select(*ids, "priority", "confidence"),
                   mask_pixels.join(free.select(*ids), ids, "left_semi"), min_area=min_area)


# --- merging and fusion ---------------------------------------------------------------------

def merge(mask_pixels: DataFrame, members: DataFrame, mode: str = "weighted") -> DataFrame:
    """Merged pixels per group: ``union``, ``intersection`` or confidence ``weighted``.

    ``members(frame_key, group_id, mask_id, confidence)``.  A merge without pixels falls back to
    the first mask of the group.
    """
    totals = members.groupBy("frame_key", "group_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("confidence").alias("_w"),
        F.min("mask_id").alias("_first"))
    px = mask_pixels.join(members, ["frame_key", "mask_id"])
    votes = px.groupBy("frame_key", "group_id", "v", "u").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("confidence").alias("_s"))
    rule = {"union": F.lit(True), "intersection": F.col("_c") == F.col("_n"),
            "weighted": F.round(F.col("_s") / F.col("_w"), 9) > 0.5}[mode]
    merged = votes.join(totals, ["frame_key", "group_id"]).filter(rule).select(
        "frame_key", "group_id", "v", "u")
    empty = totals.join(merged.select("frame_key", "group_id").distinct(),
                        ["frame_key", "group_id"], "left_anti")
    first = mask_pixels.join(empty.select("frame_key", "group_id", F.col("_first").alias("mask_id")),
                             ["frame_key", "mask_id"]).select("frame_key", "group_id", "v", "u")
    return merged.unionByName(first)


def merged_properties(members: DataFrame, mode: str = "weighted") -> DataFrame:
    """Confidence and mean valid depth of a merged mask."""
    conf = {"union": F.max, "intersection": F.min, "weighted": F.avg}[mode]("confidence")
    return members.groupBy("frame_key", "group_id").agg(
        conf.alias("confidence"), F.count(F.lit(1)).alias("n_masks"),
        F.count_distinct("source").alias("n_sources"),
        F.coalesce(F.avg(F.when(F.col("depth_median") > 0, F.col("depth_median"))), F.lit(0.0))
        .alias("depth_median"))


def with_order(masks: DataFrame) -> DataFrame:
    """Position in which masks are considered: by source, then by id."""
    source = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")),
                        F.lit(0)).cast("long")
    return masks.withColumn("pos", F.struct(source.alias("s"), F.col("mask_id").alias("m")))


def seed_groups(masks: DataFrame, packed: DataFrame, threshold: float = AGREE_IOU) -> DataFrame:
    """Group of every mask: its first agreeing seed in order, or itself if it is a seed.

    Exact copies are folded into their first one before pairs are formed (a copy always lands in
    the group of the original), so a frame full of copies stays small.
    """
    # Words are few beside the pixels they come from; they and the masks are read several times below.
    packed = checkpoint(packed.select("frame_key", "mask_id", "v", "w", "bits"))
    parts = packed.groupBy("frame_key", "mask_id").agg(
        F.sum(F.xxhash64("v", "w", "bits").cast("decimal(38,0)")).alias("_h1"),
        F.bit_xor(F.hash("v", "w", "bits")).alias("_h2"), F.sum(F.bit_count("bits")).alias("area"))
    m = with_order(masks).join(parts, ["frame_key", "mask_id"])
    sig = ["frame_key", "_h1", "_h2", "area"]
    rep = m.groupBy(*sig).agg(F.min("pos").alias("_p")).withColumn("rep", F.col("_p.m"))
    m = checkpoint(m.join(rep.select(*sig, "rep"), sig).select("frame_key", "mask_id", "pos", "area", "rep"))
    reps = m.filter("mask_id = rep").select("frame_key", "mask_id", "pos", "area")
    few = packed.join(reps.select("frame_key", "mask_id"), ["frame_key", "mask_id"], "left_semi")
    pairs = overlaps(few, reps).filter(F.col("iou") >= threshold)
    at = lambda c: reps.select("frame_key", F.col("mask_id").alias(c), F.col("pos").alias(f"p_{c}"))
    pairs = pairs.select("frame_key", "a", "b").join(at("a"), ["frame_key", "a"]).join(
        at("b"), ["frame_key", "b"])
    ahead = F.col("p_a") < F.col("p_b")
    edges = checkpoint(pairs.select(
        "frame_key", F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b"),
        F.least("p_a", "p_b").alias("pos")))
    gone = greedy_removed(edges, ["frame_key"])
    seeds = edges.join(gone.withColumnRenamed("node", "a"), ["frame_key", "a"], "left_anti")
    absorbed = seeds.groupBy("frame_key", F.col("b").alias("rep")).agg(
        F.min("pos").alias("_s")).select("frame_key", "rep", F.col("_s.m").alias("seed"))
    absorbed = absorbed.join(gone.withColumnRenamed("node", "rep"), ["frame_key", "rep"], "left_semi")
    return m.join(absorbed, ["frame_key", "rep"], "left").select(
        "frame_key", "mask_id", F.coalesce("seed", "rep").alias("group_id"))


def fused(masks: DataFrame, mask_pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Properties and pixels of the masks that the methods' masks become where they agree."""
    # One row a mask, read several times below.
    groups = checkpoint(seed_groups(masks, words(mask_pixels)))
    members = masks.join(groups, ["frame_key", "mask_id"])
    props = merged_properties(members)
    boosted = F.least(F.lit(1.0), F.col("confidence") + BOOST * F.col("n_sources") / 3.0)
    alone = F.greatest(F.lit(0.1), F.col("confidence") - PENALTY)
    props = props.withColumn("confidence", F.when(F.col("n_masks") == 1, alone).otherwise(boosted))
    return props, merge(mask_pixels, members.select("frame_key", "group_id", "mask_id", "confidence"))


def fuse(masks: DataFrame, mask_pixels: DataFrame, min_area: int = MIN_AREA,
         max_area: int = MAX_AREA) -> DataFrame:
    """Masks on which the methods agree become one, more trusted, mask; loners lose trust.

    Where frames have depth, ``depth.fuse_refined`` also takes off what does not fit it.
    """
    props, px = fused(masks, mask_pixels)
    size = shape(px, ("frame_key", "group_id"))
    return size.join(props, ["frame_key", "group_id"]).filter(
        F.col("area").between(min_area, max_area))


# --- conflicts ------------------------------------------------------------------------------

def resolve(masks: DataFrame, mask_pixels: DataFrame, limit: float = CLAIMED,
            min_area: int = MIN_AREA) -> DataFrame:
    """Masks without conflicts: higher priority first, then larger area.

    A mask that is mostly free is kept whole; otherwise only its free pixels are kept, if there are
    enough.  A mask is settled once no undecided mask ahead of it shares a pixel with it; a mask
    that the settled ones already leave too little of is dropped early.  The number of rounds is
    bounded by how many masks a frame can keep.

    ``masks(frame_key, mask_id, priority, confidence)`` to kept masks with their remaining area.
    """
    ids, at = ["frame_key", "mask_id"], ["frame_key", "v", "w"]
    # Pixels that come several times count as often, so a word keeps how often its pixels come.
    packed = mask_pixels.groupBy(*ids, "v", F.floor(F.col("u") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, u % 64)")).alias("bits"), F.count(F.lit(1)).alias("_n")).withColumn(
        "_n", F.expr("_n div bit_count(bits)"))
    size = packed.groupBy(*ids).agg(F.sum(F.col("_n") * F.bit_count("bits")).alias("area"))
    order = F.struct((-F.col("priority")).alias("p"), (-F.col("area")).alias("a"),
                     F.col("mask_id").alias("m"))
    todo = masks.join(size, ids).groupBy(*ids, "area", order.alias("ord")).agg(F.count(F.lit(1)).alias("_times"))
    px = checkpoint(packed.join(todo, ids).withColumn("_n", F.col("_n") * F.col("_times")).drop("_times"))
    ahead = W.partitionBy(*at).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    taken = None
    settled: list[DataFrame] = []
    while not px.isEmpty():
        state = px.withColumn("_ahead", F.coalesce(F.bit_or("bits").over(ahead), F.lit(0).cast("long")))
        used = F.lit(0).cast("long")
        if taken is not None:
            state = state.join(taken, at, "left")
            used = F.expr("_n * bit_count(bits & coalesce(_taken, 0L))")
        g = state.groupBy(*ids, "ord", "area").agg(
            F.count_if(F.expr("bits & _ahead <> 0")).alias("_behind"), F.sum(used).alias("_used_px"))
        crowded = F.col("_used_px") / F.col("area") >= limit
        free = F.col("area") - F.col("_used_px")
        g = g.withColumn("outcome", F.when(crowded & (free < min_area), "dropped")
                         .when(F.col("_behind") > 0, None)
                         .when(crowded, "cut").otherwise("whole"))
        done = checkpoint(g.filter(F.col("outcome").isNotNull()).select(
            "frame_key", "mask_id", "outcome",
            F.when(F.col("outcome") == "whole", F.col("area")).otherwise(free).alias("kept_area")))
        settled.append(done)
        grown = px.join(done.filter("outcome <> 'dropped'").select(*ids), ids, "left_semi").select(
            *at, F.col("bits").alias("_taken"))
        taken = checkpoint((grown if taken is None else taken.unionByName(grown)).groupBy(*at).agg(
            F.bit_or("_taken").alias("_taken")))
        px = checkpoint(px.join(done.select(*ids), ids, "left_anti"))
    if not settled:
        return masks.limit(0).withColumns({"outcome": F.lit("whole"), "kept_area": F.lit(0).cast("long")})
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    kept = out.filter("outcome <> 'dropped'").join(masks, ["frame_key", "mask_id"])
    return kept.withColumn("confidence", F.when(F.col("outcome") == "cut", F.col("confidence") * 0.9)
                           .otherwise(F.col("confidence")))
