"""Queries over embedding galleries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fleetsight.functions import vectors as vec
from fleetsight.functions.scalar import micros
from fleetsight.operators import identity as idn, objects as store
from fleetsight.operators.nearest import Search, search
from fleetsight.plans.registry import query
from fleetsight.sources import derive as src

# The test vectors are nearly orthogonal, so wide limits are needed to see matches.
WIDE_L2, WIDE_COS = 1.45, 0.74
UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
PAIRS = f"""WITH q AS MATERIALIZED (SELECT query_id, camera_id, primary_class, {UNIT.format(v='embedding')} AS v FROM {{q}}),
g AS MATERIALIZED (SELECT entry_id, object_id, camera_id, primary_class, ts, {UNIT.format(v='embedding')} AS v FROM {{g}}),
p AS (SELECT q.query_id, q.camera_id AS query_camera, q.primary_class AS query_class, g.entry_id, g.object_id, g.ts,
 g.camera_id AS gallery_camera, g.primary_class, round(2 - 2 * list_dot_product(q.v, g.v), 9) AS dist,
 round(1 - list_dot_product(q.v, g.v), 9) AS cos_dist FROM q, g WHERE {{where}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, entry_id) AS rank FROM p)
"""


def _pairs(where="true", q="vector_queries", g="gallery"):
    return PAIRS.format(where=where, q=q, g=g)


def _inputs(spark, d):
    return src.vector_queries(spark, d), src.gallery(spark, d)


def _out(df, *cols):
    return df.select(*cols, F.round("dist", 4).alias("dist"))


TOP = "SELECT query_id, entry_id, round(dist, 4) AS dist, rank::INTEGER AS rank FROM r WHERE rank <= {k}"


@query("J01_L03_knn", _pairs() + TOP.format(k=5))
def j01(spark, d):
    return _out(search(*_inputs(spark, d), Search(k=5)), "query_id", "entry_id", "rank")


@query("J01_knn_unnormalized", """
WITH p AS (SELECT q.query_id, g.entry_id, round(list_distance(q.embedding, g.embedding) ** 2, 9) AS dist
 FROM vector_queries q, gallery g), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, entry_id) AS rank FROM p)
""" + TOP.format(k=3))
def j01raw(spark, d):
    hit = search(*_inputs(spark, d), Search(k=3), normalize=False)
    return _out(hit, "query_id", "entry_id", "rank")


@query("J02_radius", _pairs() + f"""
SELECT query_id, entry_id, round(dist, 4) AS dist FROM r WHERE rank <= 100 AND dist < {WIDE_L2}""")
def j02(spark, d):
    s = Search(k=100, below_same=WIDE_L2, below_cross=WIDE_L2)
    return _out(search(*_inputs(spark, d), s), "query_id", "entry_id")


@query("J03_knn_class_filter", _pairs("g.primary_class = 'class_1'") + TOP.format(k=5))
def j03(spark, d):
    q, g = _inputs(spark, d)
    return _out(idn.retrieve(q, g, g.select("entry_id", "primary_class"), 5,
                             class_name="class_1"), "query_id", "entry_id", "rank")


@query("J03_knn_overfetch", _pairs() + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM r
 WHERE rank <= 15 AND primary_class = 'class_1')
SELECT query_id, entry_id, round(dist, 4) AS dist FROM f WHERE k <= 5""")
def j03o(spark, d):
    q, g = _inputs(spark, d)
    hit = idn.retrieve(q, g, g.select("entry_id", "primary_class"), 5, 3, "class_1")
    return _out(hit, "query_id", "entry_id")


@query("J04_same_camera_knn", _pairs("q.camera_id = g.camera_id") + TOP.format(k=5))
def j04(spark, d):
    hit = search(*_inputs(spark, d), Search(k=5, cameras="same"))
    return _out(hit, "query_id", "entry_id", "rank")


@query("J05_cross_camera_knn", _pairs("q.camera_id <> g.camera_id") + TOP.format(k=5))
def j05(spark, d):
    hit = search(*_inputs(spark, d), Search(k=5, cameras="other"))
    return _out(hit, "query_id", "entry_id", "rank")


@query("J06_camera_aware_match", _pairs(q="jittered_queries") + """, m AS (SELECT *, row_number() OVER (PARTITION BY query_id
 ORDER BY dist, entry_id) AS k FROM r WHERE dist < CASE WHEN query_camera = gallery_camera THEN 0.3 ELSE 0.25 END)
SELECT query_id, entry_id, CASE WHEN query_camera = gallery_camera THEN 'same_camera' ELSE 'cross_camera' END AS match_type,
 round(dist, 4) AS dist FROM m WHERE k = 1""")
def j06(spark, d):
    hit = idn.match_entry(src.jittered_queries(spark, d), src.gallery(spark, d))
    return _out(hit, "query_id", "entry_id", "match_type")


def _object_match(q, k, same, cross, g="gallery"):
    return _pairs(q=q, g=g) + f""", kept AS (SELECT entry_id FROM (SELECT entry_id, row_number() OVER (PARTITION BY object_id
 ORDER BY ts DESC, entry_id DESC) AS n FROM g) WHERE n <= 10),
cam AS (SELECT object_id, arg_max(camera_id, (ts, entry_id)) AS cam FROM g GROUP BY 1),
o AS (SELECT query_id, object_id, query_camera, min(cos_dist) AS d FROM p JOIN kept USING (entry_id) GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, object_id) AS rank FROM o JOIN cam USING (object_id)
 WHERE d < CASE WHEN query_camera = cam THEN {same} ELSE {cross} END)
SELECT query_id, object_id, round(1 - d, 4) AS similarity, rank::INTEGER AS rank FROM m WHERE rank <= {k}"""


def _sim(df):
    return df.select("query_id", "object_id", F.round("similarity", 4).alias("similarity"), "rank")


@query("J07_object_match", _object_match("vector_queries", 5, WIDE_COS + 0.02, WIDE_COS))
def j07(spark, d):
    q, g = _inputs(spark, d)
    return _sim(idn.match_object(q, g, 5, WIDE_COS + 0.02, WIDE_COS))


SURE = """(SELECT * FROM gallery WHERE object_id NOT IN (SELECT 'obj_' || id FROM objects WHERE classification_status = 'needs_review'))"""


@query("J08_new_objects", """WITH hits AS (""" + _object_match("gallery_queries", 1, 0.3, 0.25, SURE) + """)
SELECT query_id, camera_id FROM gallery_queries WHERE query_id NOT IN (SELECT query_id FROM hits)""")
def j08(spark, d):
    """Queries without a match in a gallery from which uncertain objects were removed."""
    q, g = src.gallery_queries(spark, d), src.gallery(spark, d)
    gone = src.objects(spark, d).filter(F.col("classification_status") == "needs_review").select(
        F.concat(F.lit("obj_"), F.col("id")).alias("object_id"))
    return idn.new_objects(q, idn.match_object(q, idn.remove_objects(g, gone), 1, 0.3, 0.25)).select("query_id", "camera_id")


@query("J09_best_object", _object_match("jittered_queries", 1, 0.3, 0.25))
def j09(spark, d):
    return _sim(idn.match_object(src.jittered_queries(spark, d), src.gallery(spark, d), 1))


@query("J21_hit_metadata", _pairs() + """
SELECT query_id, entry_id, o.id AS stored_object, round(dist, 4) AS dist FROM r
JOIN objects o ON o.id = (entry_id // 2)::VARCHAR WHERE rank <= 5""")
def j21(spark, d):
    q, g = _inputs(spark, d)
    first = F.col("id").cast("long") * 2
    meta = src.objects(spark, d).select(F.explode(F.array(first, first + 1)).alias("entry_id"),
                                        F.col("id").alias("stored_object"))
    return _out(idn.retrieve(q, g, meta, 5), "query_id", "entry_id", "stored_object")


@query("J28_approximate_knn")
def j28(spark, d):
    return _out(_approximate(src.gallery_queries(spark, d), src.gallery(spark, d)), "query_id", "entry_id", "rank")


def _approximate(q, g):
    """Half of the cells are visited; vectors without clusters need that many."""
    cells = max(1, math.ceil(math.sqrt(g.count())))
    return search(q, g, Search(k=5), nprobe=math.ceil(cells / 2), nlist=cells)


@query("J28_recall", """
SELECT count(*) AS queries, true AS enough FROM vector_queries""")
def j28r(spark, d):
    """Share of the exact neighbours that the approximate search finds, at least nine of ten."""
    q, g = _inputs(spark, d)
    exact = search(q, g, Search(k=5)).select("query_id", "entry_id")
    hits = exact.join(_approximate(q, g).select("query_id", "entry_id"), ["query_id", "entry_id"]).agg(
        F.count(F.lit(1)).alias("hits"))
    return exact.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs")).withColumn(
        "hits", hits.scalar()).select("queries", (F.col("hits") >= 0.9 * F.col("pairs")).alias("enough"))


@query("A34_matched_per_camera", _pairs(q="jittered_queries") + """
SELECT camera_id, count(*) AS queries, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS new_identities FROM (
 SELECT query_id, query_camera AS camera_id, bool_or(dist < CASE WHEN query_camera = gallery_camera THEN 0.3 ELSE 0.25 END) AS hit
 FROM p GROUP BY ALL) GROUP BY camera_id""")
def a34(spark, d):
    q = src.jittered_queries(spark, d)
    m = idn.match_entry(q, src.gallery(spark, d)).select("query_id", F.lit(True).alias("hit"))
    hit = F.coalesce("hit", F.lit(False))
    return q.join(m, "query_id", "left").groupBy("camera_id").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(hit).alias("matched"),
        F.count_if(~hit).alias("new_identities"))


def _first(v, *pos):
    return [F.round(F.element_at(v, p), 4).alias(f"e{p}") for p in pos]


@query("A15_mean_embedding", """
WITH m AS (SELECT 'obj_' || (vec_id // 20) AS object_id, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) AS t(i) GROUP BY 1, 2)
SELECT object_id, round(max(x) FILTER (i = 1) / sqrt(sum(x * x)), 4) AS e1, round(max(x) FILTER (i = 33) / sqrt(sum(x * x)), 4) AS e33,
 round(max(x) FILTER (i = 64) / sqrt(sum(x * x)), 4) AS e64 FROM m GROUP BY object_id""")
def a15(spark, d):
    e = src.table(spark, d, "embeddings").select(
        F.concat(F.lit("obj_"), F.floor(F.col("vec_id") / 20).cast("string")).alias("object_id"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    return idn.mean_embedding(e).select("object_id", *_first(F.col("embedding"), 1, 33, 64))


@query("A16_gallery_counts", """
SELECT count(*) AS size, count(DISTINCT object_id) AS objects, count(*) FILTER (entry_id % 10 <> 0) AS synced,
 count(*) FILTER (entry_id % 10 = 0) AS unsynced FROM gallery""")
def a16(spark, d):
    g = src.gallery(spark, d).withColumn("synced", F.col("entry_id") % 10 != 0)
    return idn.gallery_counts(g)


@query("A17_objects_per_camera", """
SELECT camera_id, count(DISTINCT object_id) AS objects, count(*) AS sightings FROM trajectory_points GROUP BY 1""")
def a17(spark, d):
    return src.trajectory_points(spark, d).groupBy("camera_id").agg(
        F.count_distinct("object_id").alias("objects"), F.count(F.lit(1)).alias("sightings"))


@query("W01_last_embeddings", """
SELECT object_id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY entry_id DESC) AS k FROM (
 SELECT 'obj_' || (vec_id // 40) AS object_id, vec_id AS entry_id FROM embeddings)) WHERE k <= 10""")
def w01(spark, d):
    v = F.col("vec_id")
    g = src.table(spark, d, "embeddings").select(
        F.concat(F.lit("obj_"), F.floor(v / 40).cast("string")).alias("object_id"),
        v.alias("entry_id"), v.alias("ts"))
    return idn.last_embeddings(g).select("object_id", "entry_id")


@query("W02_newest_embedding", """
SELECT object_id, max(entry_id) AS entry_id, round(arg_max(embedding[1], entry_id), 4) AS e1 FROM gallery GROUP BY 1""")
def w02(spark, d):
    n = idn.newest_embedding(src.gallery(spark, d))
    return n.select("object_id", "entry_id", *_first(F.col("embedding"), 1))


@query("U04_camera_galleries", """
SELECT camera_id, count(*) AS n FROM gallery GROUP BY 1 UNION ALL SELECT '_all', count(*) FROM gallery""")
def u04(spark, d):
    # One table serves both: a camera is a partition of it, the fleet is all of it.
    return src.gallery(spark, d).rollup("camera_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "camera_id", F.coalesce("camera_id", F.lit("_all")))


@query("S18_remove_objects", """
SELECT object_id, count(*) AS n FROM gallery WHERE object_id NOT IN (SELECT 'obj_' || id FROM objects
 WHERE classification_status = 'needs_review') GROUP BY 1""")
def s18(spark, d):
    gone = src.objects(spark, d).filter(F.col("classification_status") == "needs_review").select(
        F.concat(F.lit("obj_"), F.col("id")).alias("object_id"))
    return idn.remove_objects(src.gallery(spark, d), gone).groupBy("object_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("W10_cache_eviction", """
SELECT entry_id FROM (SELECT vec_id AS entry_id, (vec_id * 7919) % 1009 AS used FROM embeddings WHERE vec_id % 3 <> 0)
ORDER BY used, entry_id LIMIT 20""")
def w10(spark, d):
    v = F.col("vec_id")
    e = src.table(spark, d, "embeddings").select(
        v.alias("entry_id"), ((v * 7919) % 1009).alias("used"), (v % 3 != 0).alias("synced"))
    return store.evictable(e, 200, used="used").select("entry_id")


@query("J27_handoffs", """
WITH s AS (SELECT *, lag(camera_id) OVER (PARTITION BY object_id ORDER BY "timestamp", event_id) AS prev FROM trajectory_points)
SELECT object_id, event_id, prev AS from_camera, camera_id AS to_camera, epoch_us("timestamp") AS ts FROM s WHERE prev <> camera_id""")
def j27(spark, d):
    h = idn.handoffs(src.trajectory_points(spark, d))
    return h.select("object_id", "event_id", F.col("prev_camera_id").alias("from_camera"),
                    F.col("camera_id").alias("to_camera"), micros(F.col("timestamp")).alias("ts"))


@query("X12_X15_vector_functions", """
WITH p AS (SELECT q.vec_id, q.embedding::DOUBLE[] AS a, g.embedding::DOUBLE[] AS b FROM embeddings q
 JOIN embeddings g ON g.vec_id = q.vec_id + 1)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cos, round(list_distance(a, b) ** 2, 6) AS dist_sq_l2,
 round(a[1] / sqrt(list_dot_product(a, a)), 6) AS unit_first, round(list_sum((a || [0.0, 0.0])[2:66]), 4) AS padded_sum,
 round(list_sum(a[1:16]), 4) AS cut_sum FROM p""")
def x12(spark, d):
    e = src.table(spark, d, "embeddings").select("vec_id", vec.doubles(F.col("embedding")).alias("a"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4)
    return e.join(n, "vec_id").select(
        "vec_id", F.round(vec.cosine(a, b), 6).alias("cos"),
        F.round(vec.dist_sq_l2(a, b), 6).alias("dist_sq_l2"),
        F.round(F.get(vec.l2_normalize(a), 0), 6).alias("unit_first"),
        total(F.slice(vec.fit_dimension(a, 66), 2, 65)).alias("padded_sum"),
        total(vec.fit_dimension(a, 16)).alias("cut_sum"))
