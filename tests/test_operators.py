"""Worked examples, brute-force comparisons and plan checks."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetsight.functions.scalar import instant
from fleetsight.functions.windows import order_statistics, row_numbers
from fleetsight.operators import (attributes as at, blocks, depth as dp, graph, identity as idn, learning,
                                  masks as mk, nearest, objects as store, points as pt, routing, tracking as tk)
from fleetsight.operators.nearest import Search, search
from fleetsight.sources import schemas


def rng(seed=3):
    return np.random.default_rng(seed)


# --- small examples -----------------------------------------------------------------------------

def test_status_boundaries(spark):
    df = spark.createDataFrame([(0.85,), (0.5,), (0.4999,)], "confidence double")
    got = [r[0] for r in df.select(routing.status_of(F.col("confidence"))).collect()]
    assert got == ["confirmed", "provisional", "needs_review"]


def test_routing_floor_and_area(spark):
    rows = [(1, " Person ", 0.9, 999), (2, "PERSON", 0.9, 1000), (3, "truck", 0.3, 2000), (4, "truck", 0.29, 2000),
            (5, None, 0.9, 9999)]
    det = spark.createDataFrame(rows, "det_id int, class_name string, confidence double, area int")
    got = {r.det_id: (r.branch, r.route_reason) for r in routing.route(det, routing.class_routes(spark)).collect()}
    assert got == {1: ("generic", "default_fallback"), 2: ("person", "class_match"), 3: ("vehicle", "class_match"),
                   4: ("generic", "confidence_below_threshold"), 5: ("generic", "default_fallback")}


def test_ambiguity_comes_before_confirmation(spark):
    alt = spark.createDataFrame([(1, "a", 0.95), (1, "b", 0.90), (2, "a", 0.95), (2, "b", 0.2)],
                                "det_id int, class_name string, confidence double")
    det = spark.createDataFrame([(1, 0.95), (2, 0.95)], "det_id int, confidence double")
    m = routing.top_margin(alt).select("det_id", "margin")
    got = {r.det_id: r.status for r in routing.review_route(det.join(m, "det_id"), "margin").collect()}
    assert got == {1: "needs_review", 2: "confirmed"}


def test_accuracy_worked_example(spark):
    rows = [("person", "person", True)] * 8 + [("cat", "dog", False)] * 5 + [("vehicle", "person", False)] * 5
    fb = spark.createDataFrame(rows, "original_class string, corrected_class string, was_correct boolean")
    assert learning.overall(fb.limit(8)).first().accuracy == 1.0
    top = [tuple(r) for r in learning.most_confused(fb).collect()]
    assert top[0] == ("dog", "cat", 5)
    assert {r.class_name for r in learning.worst_classes(fb, 2).collect()} == {"cat", "vehicle"}


def test_empty_window_alerts(spark):
    fb = spark.createDataFrame([], "timestamp timestamp_ntz, was_correct boolean")
    r = learning.alert(fb, instant("2024-01-01 00:00:00")).first()
    assert (r.total_reviewed, r.accuracy, r.alert) == (0, 0.0, True)


def test_upsert_keeps_first_creation(spark):
    s = "id string, x int, created_at int, updated_at int"
    old = spark.createDataFrame([("a", 1, 10, 10), ("b", 1, 10, 10)], s)
    new = spark.createDataFrame([("a", 2, 20, 20), ("b", 2, 5, 9), ("c", 3, 20, 20)], s)
    got = {tuple(r) for r in store.upsert(old, new).collect()}
    assert got == {("a", 2, 10, 20), ("b", 1, 5, 10), ("c", 3, 20, 20)}


def test_stage_inputs_are_checked(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert schemas.require(df, "id long, name string") is df
    with pytest.raises(TypeError, match="name: want int"):
        schemas.require(df, "id long, name int")
    with pytest.raises(TypeError, match="missing"):
        schemas.require(df, "other any")


# --- helpers ------------------------------------------------------------------------------------

def test_percentiles_and_row_numbers(spark):
    r = rng()
    pdf = pd.DataFrame({"k": r.integers(0, 3, 5000), "v": np.round(r.exponential(50, 5000), 1)})
    pdf = pd.concat([pdf, pd.DataFrame({"k": [9], "v": [1.0]}), pd.DataFrame({"k": [7] * 50, "v": [2.5] * 50})])
    df = spark.createDataFrame(pdf)
    got = {x.k: (x.a, x.b, x.c) for x in order_statistics(df, ["k"], "v", {"a": 50.0, "b": 95.0, "c": 99.0}).collect()}
    for k, g in pdf.groupby("k"):
        s = sorted(g.v)
        assert got[k] == tuple(s[min(len(s) - 1, int(len(s) * p / 100))] for p in (50, 95, 99))
    d = df.withColumn("i", F.monotonically_increasing_id())
    n = row_numbers(d, ["k"], ["v", "i"], F.floor(F.col("v") / 7)).toPandas().sort_values(["k", "v", "i"])
    assert all(list(g.rn) == list(range(1, len(g) + 1)) for _, g in n.groupby("k"))


def test_components_match_union_find(spark):
    r = rng(5)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (260, 2))]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for n in parent}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    part = F.when(F.floor(F.col("a") / 40) == F.floor(F.col("b") / 40), F.floor(F.col("a") / 40))
    assert {r.node: r.component for r in graph.components(df.withColumn("p", part), ["p"]).collect()} == want


def test_greedy_rounds_match_loops(spark):
    r = rng(8)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 60, (150, 2)) if a != b})
    dropped = set()
    for a in range(60):
        if a not in dropped:
            dropped |= {b for x, b in edges if x == a}
    got = {x.node for x in graph.greedy_removed(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == dropped
    pairs = [(i, j, float(np.round(r.random(), 1))) for i in range(12) for j in range(12) if r.random() < .5]
    want, ls, rs = [], set(), set()
    for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if i not in ls and j not in rs:
            want.append((i, j))
            ls.add(i), rs.add(j)
    df = spark.createDataFrame([(0, *p) for p in pairs], "f long, l long, r long, s double")
    assert {(x.l, x.r) for x in graph.greedy_matching(df, ["f"], "l", "r", "s").collect()} == set(want)


# --- neighbour search -----------------------------------------------------------------------------

def _gallery(spark, n=600, dim=8, seed=1):
    r = rng(seed)
    centers = r.normal(size=(12, dim)) * 3
    g = centers[r.integers(0, 12, n)] + r.normal(size=(n, dim)) * .3
    g[: n // 3] = g[0]
    rows = [(i, f"o{i // 3}", f"c{i % 3}", [float(x) for x in v]) for i, v in enumerate(g)]
    return rows, spark.createDataFrame(rows, "entry_id long, object_id string, camera_id string, embedding array<double>")


def _truth(rows, queries, s):
    out = set()
    for q, cam, v in queries:
        best = []
        for e, o, c, w in rows:
            d = round(float(((np.array(v) - np.array(w)) ** 2).sum()), 9)
            limit = s.below_same if c == cam else s.below_cross
            if (s.cameras == "same" and c != cam) or (s.cameras == "other" and c == cam) or (
                    limit is not None and d >= limit):
                continue
            best.append((d, e))
        out |= {(q, e) for d, e in sorted(best)[: s.k]}
    return out


@pytest.mark.parametrize("s", [Search(k=4), Search(k=3, cameras="same"), Search(k=3, cameras="other"),
                               Search(k=50, below_same=2.0, below_cross=1.0)])
def test_pruned_search_is_exact(spark, s, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(blocks, "BLOCK", 64)
    rows, g = _gallery(spark)
    queries = [(1000 + i, f"c{i % 3}", [x + .01 * i for x in rows[i * 7][3]]) for i in range(40)]
    q = spark.createDataFrame(queries, "query_id long, camera_id string, embedding array<double>")
    got = search(q, g, s, normalize=False, prune_from=0)
    assert {(r.query_id, r.entry_id) for r in got.collect()} == _truth(rows, queries, s)


def test_approximate_search_recall(spark):
    _, g = _gallery(spark)
    q = g.filter("entry_id % 10 = 3").select(F.col("entry_id").alias("query_id"), "camera_id", "embedding")
    exact = search(q, g, Search(k=5), normalize=False).select("query_id", "entry_id")
    rough = search(q, g, Search(k=5), normalize=False, nprobe=4, nlist=12).select("query_id", "entry_id")
    assert rough.intersect(exact).count() >= .8 * exact.count()


def test_every_vector_is_asked_against_the_gallery(spark, tmp_path):
    from compare import _rows
    from fleetsight.plans import ORACLES, QUERIES
    import duckdb
    r = rng(11)
    n, d = 90, str(tmp_path)
    spark.createDataFrame([(i, r.normal(size=64).astype("float32").tolist(), int(i % 7)) for i in range(n)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, i % 40, "view", 90.0, "{}", i) for i in range(200)],
                          "event_id long, user_id long, event_type string, value double, props string, s long").select(
        "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(
        f"{d}/events.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    for name in ("J01_L03_knn", "J01_knn_unnormalized", "J02_radius", "J03_knn_class_filter", "J03_knn_overfetch",
                 "J04_same_camera_knn", "J05_cross_camera_knn", "J07_object_match", "J21_hit_metadata"):
        df = QUERIES[name](spark, d)
        got, sql = _rows(df.columns, [tuple(x) for x in df.collect()]), con.execute(ORACLES[name])
        assert got == _rows([c[0] for c in sql.description], sql.fetchall()), name
        asked = {x[sorted(df.columns).index("query_id")] for x in got}
        assert len(asked) > n // 3, name
        if name in ("J01_L03_knn", "J01_knn_unnormalized", "J02_radius", "J03_knn_class_filter", "J04_same_camera_knn", "J05_cross_camera_knn"):
            assert asked == set(range(n)), name
        if name == "J21_hit_metadata":
            assert {x[sorted(df.columns).index("entry_id")] % 2 for x in got} == {0, 1}
    assert QUERIES["J28_recall"](spark, d).first()["queries"] == n


def test_identity_assignment_matches_loop(spark):
    r = rng(11)
    base = r.normal(size=(6, 8))
    unit = lambda v: v / np.linalg.norm(v)
    qs = [unit(base[i % 6] + r.normal(size=8) * .35) for i in range(60)]
    gal = [unit(base[i]) for i in range(2)]
    known = [(f"g{i}", v) for i, v in enumerate(gal)]
    want = {}
    for i, v in enumerate(qs):
        best = max(((round(1 - round(1 - float(v @ w), 9), 9), n) for n, w in known), key=lambda t: t[0])
        if 1 - best[0] < .2:
            want[i] = (best[1], False)
        else:
            known.append((f"new_{i}", v))
            want[i] = (f"new_{i}", True)
    q = spark.createDataFrame([(i, "c0", [float(x) for x in v]) for i, v in enumerate(qs)],
                              "query_id long, camera_id string, embedding array<double>")
    g = spark.createDataFrame([(i, f"g{i}", "c0", [float(x) for x in v], i) for i, v in enumerate(gal)],
                              "entry_id long, object_id string, camera_id string, embedding array<double>, ts long")
    got = {x.query_id: (x.object_id, x.is_new) for x in idn.assign_identities(q, g, .2, .2).collect()}
    assert got == want


# --- tracking ---------------------------------------------------------------------------------------

def _loop_tracker(rows, rules):
    """Plain replay of one camera, frame by frame."""
    tracks, out, nxt = [], {}, 1
    frames = {f: list(g) for f, g in itertools.groupby(sorted(rows), key=lambda r: r[0])}
    for f in range(min(frames), max(frames) + 1):
        dets = frames.get(f, [])
        box = [t["box"] + np.tile(t["v"], 2) if t["s"] == "lost" and t["v"] is not None else t["box"] for t in tracks]
        m = np.zeros((len(dets), len(tracks)))
        for i, d in enumerate(dets):
            for j, b in enumerate(box):
                m[i, j] = tk._iou_matrix(np.array([d[2]], float), np.array([b], float))[0, 0]
        hit = {}
        while m.size and m.max() >= rules.match:
            i, j = np.unravel_index(m.argmax(), m.shape)
            hit[j] = i
            m[i, :] = 0
            m[:, j] = 0
        for j, t in enumerate(tracks):
            if j in hit:
                b = np.array(dets[hit[j]][2], float)
                t["v"] = ((b - t["box"])[:2] + (b - t["box"])[2:]) / 2
                t["box"], t["h"], t["g"] = b, t["h"] + 1, 0
                if t["s"] == "lost" or (t["s"] == "tentative" and t["h"] >= rules.confirm):
                    t["s"] = "confirmed"
                out[dets[hit[j]][1]] = (t["id"], t["s"], t["h"])
            else:
                t["g"] += 1
                t["s"] = "lost" if t["s"] == "confirmed" else t["s"]
        for i, d in enumerate(dets):
            if i not in hit.values():
                tracks.append({"id": nxt, "box": np.array(d[2], float), "v": None, "s": "tentative", "h": 1, "g": 0})
                out[d[1]] = (nxt, "tentative", 1)
                nxt += 1
        tracks = [t for t in tracks if t["g"] <= rules.buffer]
    return out


@pytest.mark.parametrize("speed", [40.0, 0.0])
def test_replay_matches_plain_loop(spark, speed):
    r = rng(4)
    rows, ident = [], 0
    for cam in range(2):
        for o in range(9):
            x, y = r.integers(0, 900, 2)
            v = r.integers(-4, 5, 2)
            for f in range(90):
                if r.random() < .7 and not (25 < f < 62 and o % 3 == 0):
                    jx, jy = r.integers(-2, 3, 2)
                    x1, y1 = int(x + v[0] * f + jx), int(y + v[1] * f + jy)
                    rows.append((f"c{cam}", f, ident, .9, x1, y1, x1 + 60, y1 + 80))
                    ident += 1
    df = spark.createDataFrame(rows, "camera_id string, frame_no long, det_id long, confidence double, x1 int, y1 int, x2 int, y2 int")
    rules = tk.Rules(match=.6)
    got = {x.det_id: (x.track_id, x.state, x.hits) for x in tk.replay(df, rules, speed).collect()}
    want = {}
    for cam in ("c0", "c1"):
        want |= _loop_tracker([(f, i, (a, b, c, d)) for k, f, i, _, a, b, c, d in rows if k == cam], rules)
    assert got == want


def _busy(seed, frames, objects, gaps=True):
    """One camera whose objects move through each other for many frames; equal boxes come up as well."""
    r, rows = rng(seed), []
    for o in range(objects):
        x, y = r.integers(0, 300, 2)
        v = r.integers(-2, 3, 2)
        for f in range(frames):
            if r.random() < .75 and not (gaps and o % 4 == 0 and f % 97 > 60):
                jx, jy = r.integers(-1, 2, 2) if o % 3 else (0, 0)
                x1, y1 = int(x + (v[0] * f) % 120 + jx), int(y + (v[1] * f) % 90 + jy)
                rows.append(("c0", f, len(rows), .9, x1, y1, x1 + 60, y1 + 80))
                if o == 1 and f % 5 == 0:
                    rows.append(("c0", f, len(rows), .9, x1, y1, x1 + 60, y1 + 80))
    return rows


DET = "camera_id string, frame_no long, det_id long, confidence double, x1 int, y1 int, x2 int, y2 int"


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_in_time_chunks_matches_plain_loop(spark, seed):
    rules = tk.Rules(match=.6, buffer=5)
    rows = _busy(seed, 150, 7)
    df = spark.createDataFrame(rows, DET)
    got = {x.det_id: (x.track_id, x.state, x.hits) for x in tk.replay(df, rules, 8.0, length=18).collect()}
    assert got == _loop_tracker([(f, i, (a, b, c, d)) for _, f, i, _, a, b, c, d in rows], rules)


def test_chunks_are_walked_again_until_borders_agree(spark):
    """With frames to warm up that are too few, guesses are wrong and only the walks that follow mend them."""
    rules = tk.Rules(match=.6, buffer=5)
    rows = _busy(3, 80, 5)
    det = spark.createDataFrame(rows, DET).withColumn("region", F.lit(0).cast("long"))
    whole = {x.det_id: (x.birth_id, x.state, x.age, x.hits, x.missed, x.vx, x.vy)
             for x in tk._by_chunks(det, rules, 1000, 0).collect()}
    for length, warm in ((10, 0), (10, 3), (7, 7)):
        got = {x.det_id: (x.birth_id, x.state, x.age, x.hits, x.missed, x.vx, x.vy)
               for x in tk._by_chunks(det, rules, length, warm).collect()}
        assert got == whole


def test_velocity_example(spark):
    df = spark.createDataFrame([(1, 1, 100, 100, 200, 200), (1, 2, 110, 105, 210, 205)],
                               "object_key long, frame_no long, x1 int, y1 int, x2 int, y2 int")
    last = tk.velocities(df).filter("frame_no = 2").first()
    assert (last.vx, last.vy, last.next_x1, last.next_y2) == (10.0, 5.0, 120.0, 210.0)


def test_suppression_keeps_no_overlap(spark):
    r = rng(6)
    rows = [(i % 2, i, float(np.round(r.random(), 2)), *map(int, (x, y, x + w, y + h)))
            for i, (x, y, w, h) in enumerate(zip(r.integers(0, 200, 80), r.integers(0, 200, 80),
                                                 r.integers(30, 90, 80), r.integers(30, 90, 80)))]
    rows += [(0, 1000 + i, .5, 10, 10, 60, 60) for i in range(30)]
    df = spark.createDataFrame(rows, "frame_key long, det_id long, confidence double, x1 int, y1 int, x2 int, y2 int")
    kept = {x.det_id for x in tk.keep_best_boxes(df, ["frame_key"], "det_id", .4).collect()}
    want = set()
    for f in (0, 1):
        chosen = []
        for row in sorted((x for x in rows if x[0] == f), key=lambda x: (-x[2], x[1])):
            if all(tk._iou_matrix(np.array([row[3:]], float), np.array([c[3:]], float))[0, 0] <= .4 for c in chosen):
                chosen.append(row)
        want |= {c[1] for c in chosen}
    assert kept == want


# --- masks, depth, points ---------------------------------------------------------------------------

def test_conflicts_match_loop(spark):
    r = rng(9)
    boxes = {i: (i % 3, *map(int, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(
        r.integers(0, 40, 40), r.integers(0, 30, 40), r.integers(5, 20, 40), r.integers(5, 15, 40)))}
    px = {i: {(v, u) for v in range(b[2], b[4]) for u in range(b[1], b[3])} for i, b in boxes.items()}
    want = {}
    for f in (0, 1, 2):
        claimed = set()
        for i in sorted((i for i in boxes if boxes[i][0] == f), key=lambda i: (-(i % 2), -len(px[i]), i)):
            over = len(px[i] & claimed)
            if over / len(px[i]) < .5:
                want[i] = ("whole", len(px[i]))
            elif len(px[i]) - over >= 30:
                want[i] = ("cut", len(px[i]) - over)
            else:
                continue
            claimed |= px[i]
    m = spark.createDataFrame([(b[0], i, i % 2, .8) for i, b in boxes.items()],
                              "frame_key long, mask_id long, priority int, confidence double")
    p = spark.createDataFrame([(boxes[i][0], i, v, u) for i in px for v, u in px[i]],
                              "frame_key long, mask_id long, v int, u int")
    got = {x.mask_id: (x.outcome, x.kept_area) for x in mk.resolve(m, p, min_area=30).collect()}
    assert got == want


def test_words_round_trip(spark):
    px = spark.createDataFrame([(1, 1, 0, u) for u in (0, 5, 63, 64, 130)], "frame_key long, mask_id long, v int, u int")
    assert {r.u for r in mk.unpack(mk.words(px)).collect()} == {0, 5, 63, 64, 130}


def _naive_morph(s, what, n, w, h):
    near = lambda v, u: {(a, b) for a in range(max(0, v - n), min(h, v + n + 1)) for b in range(max(0, u - n), min(w, u + n + 1))}
    if what == "dilate":
        return set().union(*[near(v, u) for v, u in s]) if s else set()
    return {(v, u) for v, u in s if near(v, u) <= s}


def test_morphology_and_holes(spark):
    r = rng(2)
    s = {(int(v), int(u)) for v, u in r.integers(0, 20, (120, 2))}
    px = spark.createDataFrame([(1, v, u) for v, u in s], "mask_id long, v int, u int")
    want = s
    for what, n in dp.CLOSE + dp.OPEN:
        want = _naive_morph(want, what, n, 20, 20)
    got = {(x.v, x.u) for x in dp.morphology(px, ["mask_id"], dp.CLOSE + dp.OPEN, 20, 20).collect()}
    assert got == want
    ring = [(1, v, u) for v in range(3, 10) for u in range(3, 10) if v in (3, 9) or u in (3, 9)]
    full = dp.morphology(spark.createDataFrame(ring, "mask_id long, v int, u int"), ["mask_id"], [("fill", 0)], 20, 20)
    assert full.count() == 49


def test_depth_split(spark):
    rows = [(1, 7, v, u, 1000 if u < 10 else 3000) for v in range(20) for u in range(20)]
    px = spark.createDataFrame(rows, "frame_key long, mask_id long, v int, u int, depth_raw int")
    parts = dp.split_masks(px.drop("depth_raw"), px.drop("mask_id"), 64, 48).collect()
    assert sorted((p.area, p.depth_median) for p in parts) == [(200, 1.0), (200, 3.0)]


def _cloud(seed, n=400):
    r = rng(seed)
    p = np.concatenate([r.normal(size=(n // 2, 3)) * .3, r.random((n // 4, 3)) * 4, np.zeros((n // 4, 3))])
    return [(i % 2, i, *map(float, v)) for i, v in enumerate(p)]


CLOUD = "frame_key long, point_id long, x double, y double, z double"


@pytest.mark.parametrize("target", [16, 100000])
def test_nearest_distances_exact(spark, target):
    rows = _cloud(1)
    got = {x.point_id: x.ds for x in pt.nearest_distances(spark.createDataFrame(rows, CLOUD), 7, target).collect()}
    a = np.array([r[2:] for r in rows])
    for f, i, *xyz in rows:
        d = sorted(np.sqrt(((a - np.array(xyz)) ** 2).sum(1))[[j for j, r in enumerate(rows) if r[0] == f and j != i]])
        assert np.allclose(got[i], d[:7])


@pytest.mark.parametrize("few", [1024, 0])
def test_clusters_and_counts_exact(spark, few, monkeypatch):
    monkeypatch.setattr(pt, "FEW", few)
    rows = _cloud(2)
    df = spark.createDataFrame(rows, CLOUD)
    a, tol = np.array([r[2:] for r in rows]), .25
    near = (np.sqrt(((a[:, None] - a[None]) ** 2).sum(2)) <= tol) & (
        np.array([r[0] for r in rows])[:, None] == np.array([r[0] for r in rows])[None])
    counts = {x.point_id: x.neighbours for x in pt.radius_counts(df, tol).collect()}
    assert counts == {i: int(near[i].sum()) - 1 for i in range(len(rows))}
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in np.nonzero(near[i])[0]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    size = {k: label.count(k) for k in set(label)}
    got = {x.point_id: x.cluster for x in pt.clusters(df, tol, 3, 10 ** 6).collect()}
    assert got == {i: k for i, k in enumerate(label) if size[k] >= 3}


def test_plane_is_found_and_removed(spark):
    r = rng(3)
    flat = [(0, i, float(x), float(y), 1.0) for i, (x, y) in enumerate(r.random((300, 2)))]
    rows = flat + [(0, 1000 + i, .5, .5, 1.0 - .1 * (i + 1)) for i in range(3)]
    df = spark.createDataFrame(rows, CLOUD)
    plane = pt.dominant_plane(df, 50)
    p = plane.first()
    assert p.inliers == 300 and abs(p.nz + 1) < 1e-9
    assert {x.point_id for x in pt.remove_plane(df, plane).collect()} == {1000, 1001, 1002}


def test_hull_and_orientation_names(spark):
    px = spark.createDataFrame([(1, 1, v, u) for v in range(10) for u in range(10) if u <= v],
                               "frame_key long, mask_id long, v int, u int")
    s = at.shape_features(px).first()
    assert s.area == 55 and s.aspect_ratio == 1.0 and abs(s.extent - .55) < 1e-9 and .9 < s.solidity <= 1.0


def test_outlines_of_drawn_shapes(spark):
    inside = {
        (1, "circular"): lambda v, u: (v - 30) ** 2 + (u - 30) ** 2 <= 25 ** 2,
        (2, "oval"): lambda v, u: ((v - 30) / 16) ** 2 + ((u - 30) / 24) ** 2 <= 1,
        (3, "triangular"): lambda v, u: 10 <= v < 50 and 10 <= u <= v,
        (4, "irregular"): lambda v, u: 5 <= v < 55 and 5 <= u < 55 and (u < 12 or v > 47),
        (5, "polygon"): lambda v, u: v == 30 and u == 30,
    }
    px = spark.createDataFrame([(1, i, v, u) for (i, _), f in inside.items() for v in range(60) for u in range(60)
                                if f(v, u)], "frame_key long, mask_id long, v int, u int")
    s = at.shape_features(px).withColumn("kind", at.shape_type(*[F.col(c) for c in (
        "aspect_ratio", "circularity", "vertices", "solidity")]))
    got = {r.mask_id: r for r in s.collect()}
    assert {(i, r.kind) for i, r in got.items()} == set(inside)
    assert got[1].circularity > .85 and got[5].vertices == 1 and got[5].circularity == 0
    square = at.outline(np.arange(20), np.zeros(20), np.full(20, 19))
    assert at.corner_count(square) == 4 and abs(at.outline_circularity(square) - np.pi / 4) < 1e-9
    star = np.array([(0, 0), (10, 4), (20, 0), (16, 10), (20, 20), (10, 16), (0, 20), (4, 10)], float)
    assert at.corner_count(star) == 8


def test_long_lists_of_routes_are_not_broadcast(spark, monkeypatch):
    from fleetsight.functions import joins
    det = spark.createDataFrame([(1, "Robot 7"), (2, "person"), (3, None)], "det_id long, class_name string")
    routes = routing.class_routes(spark).union(spark.range(500).select(
        F.concat(F.lit("robot "), F.col("id").cast("string")), F.lit("vehicle")))
    want = {1: "vehicle", 2: "person", 3: "generic"}
    few = routing.lookup_branch(det, routes)
    assert "BroadcastHashJoin" in _plan(few) and {r.det_id: r.branch for r in few.collect()} == want
    monkeypatch.setattr(joins.checked_broadcast, "__defaults__", (100,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = routing.lookup_branch(det, routes)
        assert "BroadcastHashJoin" not in _plan(many) and {r.det_id: r.branch for r in many.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- plans --------------------------------------------------------------------------------------------

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    from fleetsight.plans import QUERIES
    assert "PushedFilters: [IsNotNull(user_id)" in _plan(QUERIES["S03_object_by_id"](spark, sf_dir)) or \
        "user_id" in _plan(QUERIES["S03_object_by_id"](spark, sf_dir))
    assert "WindowGroupLimit" in _plan(QUERIES["W08_bounded_history"](spark, sf_dir))
    for name in ("flagship_route_status", "J06_camera_aware_match", "J12_mask_overlaps", "J24_nearest_points", "X20_sampling_priority"):
        plan = _plan(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_long_chains_need_no_round_limit(spark):
    """A chain of 1,000 nodes: every second one is dropped, and every second pair is taken."""
    from fleetsight.operators.graph import greedy_matching, greedy_removed
    chain = spark.range(1000).selectExpr("cast(1 as bigint) as frame", "id as a", "id + 1 as b")
    gone = greedy_removed(chain, ["frame"])
    assert sorted(r["node"] for r in gone.collect()) == list(range(1, 1001, 2))
    pairs = spark.range(1000).selectExpr("id as l", "id as r", "cast(1000 - id as double) as s").unionByName(
        spark.range(999).selectExpr("id as l", "id + 1 as r", "cast(1000 - id as double) - 0.5 as s"))
    took = greedy_matching(pairs, [], "l", "r", "s")
    assert sorted((r["l"], r["r"]) for r in took.collect()) == [(i, i) for i in range(1000)]


def test_fusion_takes_off_what_does_not_fit_the_depth(spark):
    """Two methods agree on a box of 20 x 20 whose right quarter is far behind; a third mask is level."""
    masks = spark.createDataFrame([(0, 1, "fastsam", 0.8, 0, 0, 20, 20, 1.0), (0, 2, "depth", 0.8, 0, 0, 20, 20, 1.4), (0, 3, "depth", 0.6, 30, 20, 45, 35, 2.0)],
                                  "frame_key long, mask_id long, source string, confidence double, x1 int, y1 int, x2 int, y2 int, depth_median double")
    px = [(0, m, v, u) for m in (1, 2) for v in range(20) for u in range(20)] + [(0, 3, v, u) for v in range(20, 35) for u in range(30, 45)]
    px = spark.createDataFrame(px, "frame_key long, mask_id long, v int, u int")
    depth = spark.createDataFrame([(0, v, u, 3000 if u in range(15, 20) else 1000 if u < 20 else 2000) for v in range(48) for u in range(64)],
                                  "frame_key long, v int, u int, depth_raw int")
    got = {r.group_id: r for r in dp.fuse_refined(masks, px, depth, 64, 48, min_area=100).collect()}
    plain = {r.group_id: r for r in mk.fuse(masks, px, min_area=100).collect()}
    assert (plain[1].area, plain[1].bx2, got[1].area, got[1].bx2, got[1].depth_median) == (400, 19, 300, 14, 1.0)
    assert plain[1].depth_median == pytest.approx(1.2) and got[1].confidence == plain[1].confidence
    assert (got[3].area, got[3].depth_median) == (plain[3].area, plain[3].depth_median) == (225, 2.0)
    some = dp.fuse_refined(masks, px, depth, 64, 48, least=301, min_area=100).collect()      # too little is left
    assert {r.group_id: r.area for r in some} == {1: 400, 3: 225}
