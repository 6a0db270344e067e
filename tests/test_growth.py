"""Steps whose work or memory must not grow with the square of their input."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetsight.operators import attributes as at, blocks, depth as dp, graph, masks as mk, nearest, points as pt, routing, tracking as tk
from fleetsight.operators.nearest import Search
from fleetsight.streaming import ordered


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _peak(call):
    tracemalloc.start()
    try:
        out = call()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_aligned_frames_read_no_window_to_its_end(spark):
    rows = [(1, "cam_0", 10), (2, "cam_1", 4), (3, "cam_1", 13), (4, "cam_2", 16), (5, "cam_0", 13), (6, "cam_2", 10),
            (7, "cam_1", 13), (8, "cam_0", 99)]
    frames = spark.createDataFrame(rows, "det_id long, camera_id string, s long").select(
        "det_id", "camera_id", F.timestamp_seconds("s").alias("ts"))
    got = tk.align_frames(frames, "cam_0", 5_000_000)
    assert "unboundedfollowing" not in _plan(got).lower()
    assert sorted(tuple(r) for r in got.collect()) == [(1, "cam_1", 3, 3_000_000), (1, "cam_2", 6, 0), (5, "cam_1", 3, 0),
                                                       (5, "cam_2", 4, 3_000_000)]


@pytest.mark.parametrize("threshold", [0.5, 0.2])
def test_recovered_class_lists_no_pairs(spark, threshold, monkeypatch):
    def listed(*_, **__):
        raise AssertionError("pairs of boxes are listed")

    monkeypatch.setattr(tk, "box_pairs", listed)
    r = np.random.default_rng(5)
    rows = [(int(i % 2), i, f"c{i % 7}", *map(int, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(
        zip(r.integers(0, 300, 120), r.integers(0, 300, 120), r.integers(1, 300, 120), r.integers(1, 300, 120)))]
    rows += [(f, i + 200, "copy", *b) for f, i, _, *b in rows[:40]]
    det = spark.createDataFrame(rows, "frame_no long, det_idx long, class_name string, x1 int, y1 int, x2 int, y2 int")
    boxes = det.select("frame_no", F.col("det_idx").alias("box_id"), "x1", "y1", "x2", "y2")
    got = {(x.frame_no, x.box_id): x.recovered_class for x in routing.recover_class(boxes, det, ["frame_no"], threshold).collect()}
    one = lambda x: np.array([x[3:]], float)
    want = {}
    for a in rows:
        want[a[0], a[1]] = next(b[2] for b in rows if a[0] == b[0] and tk._iou_matrix(one(a), one(b))[0, 0] > threshold)
    assert got == want


def test_tracks_are_matched_without_a_matrix_of_all_boxes():
    r = np.random.default_rng(2)
    at = np.concatenate([r.integers(0, 500, (1500, 2)), np.repeat([[40, 50]], 500, 0)])
    boxes = np.hstack([at, at + [60, 120]]).astype(float)
    walk = tk.Replay(tk.Rules())

    def steps():
        walk.frame(1, boxes)
        return walk.frame(2, boxes + 1)

    found, peak = _peak(steps)
    assert peak < 25
    m = tk._iou_matrix(boxes + 1, boxes)
    i, j = np.nonzero(m >= 0.8)
    left, right = set(), set()
    for k in np.lexsort((j, i, -m[i, j])):
        if i[k] not in left and j[k] not in right:
            left.add(i[k])
            right.add(j[k])
            assert (found[i[k]][0][tk._VEL] == tuple(((boxes[i[k]] + 1) - boxes[j[k]])[:2]))
    assert [f[0][tk._HITS] for f in found] == [2 if n in left else 1 for n in range(len(boxes))]


@pytest.mark.parametrize("sorted_pairs", [1 << 20, 40])
def test_greedy_matching_of_boxes_lists_few_pairs(spark, sorted_pairs, monkeypatch):
    r = np.random.default_rng(8)
    at = np.concatenate([r.integers(0, 60, (70, 2)), np.repeat([[10, 12]], 15, 0)])
    boxes = np.hstack([at, at + [60, 120]]).astype(float)
    a, b = boxes[r.permutation(85)], boxes[r.permutation(85)] + [1, 0, 1, 0]
    left, right = r.permutation(85) + 1000, r.permutation(85)
    monkeypatch.setattr(tk, "SORTED", sorted_pairs)
    i, j, m = tk._one_to_one(a, b, left, right, 0.3)
    iou, used, want = tk._iou_matrix(a, b), set(), {}
    for x, y in sorted(zip(*np.nonzero(iou >= 0.3)), key=lambda e: (-iou[e], left[e[0]], right[e[1]])):
        if ("l", x) not in used and ("r", y) not in used:
            used |= {("l", x), ("r", y)}
            want[int(x), int(y)] = iou[x, y]
    assert dict(zip(zip(i.tolist(), j.tolist()), m)) == want
    if sorted_pairs < 100:
        return
    frame = lambda ids, box, name: spark.createDataFrame(
        [(None if k == 3 else int(k % 2), int(n), *map(float, x)) for k, (n, x) in enumerate(zip(ids, box))],
        f"frame_no long, {name} long, x1 double, y1 double, x2 double, y2 double")
    det, tracks = frame(left, a, "det_id"), frame(right, b, "track_key")
    pairs = lambda single: tk.box_pairs(det, tracks, ["frame_no"], "det_id", "track_key", 0.3, single=single)
    got = [graph.greedy_matching(pairs(x), ["frame_no"], "det_id", "track_key", "iou").collect() for x in (False, True)]
    assert sorted(got[0]) == sorted(got[1])
    assert pairs(True).count() == len(got[0]) < pairs(False).count() / 5


def test_greedy_matching_holds_few_pairs():
    at = np.repeat(np.random.default_rng(4).integers(0, 400, (400, 2)), 5, 0)
    boxes = np.hstack([at, at + [60, 120]]).astype(float)
    ids = np.arange(len(boxes))
    (i, j, _), peak = _peak(lambda: tk._one_to_one(boxes, boxes, ids, ids, 0.01))
    assert (i == j).all() and len(i) == len(boxes) and peak < 160


def test_planes_are_counted_in_slices(monkeypatch):
    class Taken(Exception):
        pass

    def take(left, right, keys, a, b, kernel, schema):
        raise Taken(kernel)

    class Table:
        def select(self, *_):
            return self

    monkeypatch.setattr(pt, "blockwise", take)
    with pytest.raises(Taken) as got:
        pt.inlier_counts(Table(), Table(), 0.05)
    r = np.random.default_rng(1)
    points = pd.DataFrame(r.uniform(0, 1, (2048, 3)), columns=list("xyz"))
    planes = pd.DataFrame(r.uniform(-1, 1, (1000, 6)), columns=["nx", "ny", "nz", "px", "py", "pz"]).assign(
        frame_key=1, candidate=range(1000))
    out, peak = _peak(lambda: got.value.args[0](points, planes))
    assert peak < 6
    n, p = planes[["nx", "ny", "nz"]].to_numpy(), planes[["px", "py", "pz"]].to_numpy()
    near = np.abs(points.to_numpy() @ n.T - (n * p).sum(1)) < 0.05
    assert out["inliers"].tolist() == near.sum(0).tolist()


@pytest.mark.parametrize("s", [Search(k=2, below_same=0.3, below_cross=0.25),
                               Search(k=2, metric="cosine", below_same=0.3, below_cross=0.25, per="object_id"),
                               Search(k=3), Search(k=3, metric="cosine", per="object_id", cameras="other")])
def test_search_holds_few_distances(s):
    r = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    g = unit(r.normal(size=(1500, 8)))
    q = unit(g[:1500] + 0.02 * r.normal(size=(1500, 8)))
    left = pd.DataFrame({"query_id": range(1500), "camera_id": [f"c{i % 3}" for i in range(1500)], "vec": list(q)})
    right = pd.DataFrame({"entry_id": range(1500), "object_id": [f"o{i // 4}" for i in range(1500)],
                          "camera_id": [f"c{i % 2}" for i in range(1500)], "vec": list(g)})
    out, peak = _peak(lambda: nearest._kernel(s)(left, right))
    assert peak < 45
    dots = q @ g.T
    d = np.round(1 - dots if s.metric == "cosine" else ((q[:, None] - g[None]) ** 2).sum(2), 9)
    got = {i: list(zip(x["dist"].round(8), x["entry_id"])) for i, x in out.groupby("query_id")}
    for i in range(0, 1500, 50):
        best = {}
        for j in range(1500):
            same = f"c{i % 3}" == f"c{j % 2}"
            limit = s.below_same if same else s.below_cross
            if (s.cameras == "other" and same) or (limit is not None and d[i, j] >= limit):
                continue
            key = f"o{j // 4}" if s.per == "object_id" else j
            best[key] = min(best.get(key, (9, 9)), (d[i, j].round(8), j))
        assert got.get(i, []) == sorted(best.values())[:s.k]


def test_conflicts_are_settled_on_words(spark, monkeypatch):
    sizes = []

    def counted(df):
        sizes.append(df.count())
        return keep(df)

    keep = mk.checkpoint
    monkeypatch.setattr(mk, "checkpoint", counted)
    masks = spark.createDataFrame([(1, 1, 0, .5), (1, 2, 1, .5), (1, 3, 0, .5)],
                                  "frame_key long, mask_id long, priority int, confidence double")
    px = [(1, m, v, u) for m, a, b in ((1, 60, 80), (2, 70, 90), (3, 62, 82)) for v in range(10) for u in range(a, b)]
    out = mk.resolve(masks, spark.createDataFrame(px, "frame_key long, mask_id long, v int, u int"), min_area=10)
    assert {(r.mask_id, r.outcome, r.kept_area) for r in out.collect()} == {(2, "whole", 200), (1, "cut", 100)}
    assert max(sizes) <= 60


def test_fusion_finds_its_groups_once(spark):
    masks = spark.createDataFrame([(1, 1, "fastsam", .5, 1.0), (1, 2, "depth", .7, 1.0)],
                                  "frame_key long, mask_id long, source string, confidence double, depth_median double")
    px = spark.createDataFrame([(1, m, v, u) for m in (1, 2) for v in range(5) for u in range(5)],
                               "frame_key long, mask_id long, v int, u int")
    props, merged = mk.fused(masks, px)
    assert "xxhash64" not in _plan(props) + _plan(merged)
    assert merged.count() == 25


def test_cells_of_a_batch_hold_few_distances(spark):
    r = np.random.default_rng(3)
    vecs, pivots = r.normal(size=(10_000, 8)), r.normal(size=(3_000, 8))
    (cell, dist), peak = _peak(lambda: nearest._cells(pivots, vecs))
    assert peak < 60
    for i in (0, 4_321, 9_999):
        d = np.sqrt(((pivots - vecs[i]) ** 2).sum(1))
        assert cell[i] == d.argmin() and dist[i] == pytest.approx(d.min())


def test_approximate_search_sends_no_distances_between_cells(spark, monkeypatch):
    seen = []
    measure = nearest._to_pivots
    monkeypatch.setattr(nearest, "_to_pivots", lambda p, v: seen.append(v is p) or measure(p, v))
    r = np.random.default_rng(4)
    rows = [(i, f"o{i}", "c0", r.normal(size=4).tolist()) for i in range(60)]
    g = spark.createDataFrame(rows, "entry_id long, object_id string, camera_id string, embedding array<double>")
    q = g.selectExpr("entry_id AS query_id", "camera_id", "embedding")
    found = nearest.search(q, g, Search(k=1), nprobe=4, nlist=4).collect()
    assert not any(seen)
    assert sorted((x.query_id, x.entry_id) for x in found) == [(i, i) for i in range(60)]


def test_bins_leave_the_tasks_as_counts(spark):
    px = [(1, 1, v, u, 40, 40, (u * 7) % 256, (v * 5) % 256, (u * v) % 256, 0) for v in range(40) for u in range(40)]
    crop = spark.createDataFrame(px, "frame_key long, mask_id long, v int, u int, h int, w int, b int, g int, r int, depth_raw int")
    rows = at._bin_counts(crop, 32).collect()
    assert len(rows) <= 5 * 32 * 40
    sums = {}
    for x in rows:
        sums[x.slot // 32] = sums.get(x.slot // 32, 0) + x.n
    assert all(sums[k] == 1600 for k in (0, 1, 2, 4)) and 0 < sums[3] <= 1600
    e = np.array(at.histogram_embeddings(crop).first().embedding)
    assert len(e) == 512 and np.linalg.norm(e) == pytest.approx(1) and not e[160:].any()


def _hull_area(points):
    pts, chain = sorted(set(points)), []
    for seq in (pts, pts[::-1]):
        part = []
        for p in seq:
            while len(part) > 1 and ((part[-1][0] - part[-2][0]) * (p[1] - part[-2][1])
                                     - (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0])) <= 0:
                part.pop()
            part.append(p)
        chain += part[:-1]
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(chain, chain[1:] + chain[:1]))) / 2


def test_shapes_of_many_masks_at_once():
    r = np.random.default_rng(7)
    masks = [(np.array([3]), np.array([5]), np.array([6])), (np.arange(9), np.full(9, 2), np.full(9, 3)),
             (np.array([4]), np.array([1]), np.array([9])), (np.arange(30), abs(np.arange(30) - 15), np.full(30, 40))]
    for n in r.integers(1, 60, 200):
        v = np.sort(r.choice(80, n, replace=False))
        a = r.integers(0, 50, n)
        masks.append((v, a, a + r.integers(1, 30, n)))
    part = np.repeat(np.arange(len(masks)), [len(m[0]) for m in masks])
    mixed = r.permutation(len(part))
    got = at._row_shapes(part[mixed], *(np.concatenate(c)[mixed] for c in zip(*masks)), len(masks))
    for i, (v, a, b) in enumerate(masks):
        line = at.outline(v, a, b - 1)
        corners = [(x, y) for x, y in zip(np.concatenate([a, a, b, b]).tolist(), np.concatenate([v, v + 1, v, v + 1]).tolist())]
        assert got["hull"][i] == _hull_area(corners)
        assert got["circularity"][i] == pytest.approx(at.outline_circularity(line))
        assert got["vertices"][i] == at.corner_count(line)


def test_depths_of_many_masks_at_once():
    r = np.random.default_rng(8)
    parts = [(np.sort(r.choice(6000, n, replace=False)).astype(float), r.integers(1, 90, n).astype(float), int(r.integers(2, 4)))
             for n in r.integers(2, 40, 150)]
    part = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    got = dp._lloyd(part, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                    np.array([p[2] for p in parts]))
    for i, (x, w, k) in enumerate(parts):
        centers = np.linspace(x.min(), x.max(), k)
        for _ in range(10):
            label = np.abs(x[:, None] - centers).argmin(1)
            moved = np.array([np.average(x[label == c], weights=w[label == c]) if (label == c).any() else centers[c] for c in range(k)])
            if np.abs(moved - centers).max() < 0.5:
                break
            centers = moved
        assert got[part == i].tolist() == np.abs(x[:, None] - centers).argmin(1).tolist()


def test_morphology_of_masks_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(dp, "STACK", 700)
    r = np.random.default_rng(9)
    masks = {}
    for i, n in enumerate(r.integers(1, 20, 12)):
        v, u = r.integers(0, 24, 2)
        masks[i] = {(int(a), int(b)) for a, b in zip(np.minimum(23, v + r.integers(0, n, n * n)), np.minimum(29, u + r.integers(0, n, n * n)))}
    px = spark.createDataFrame([(f"s{i % 2}", i, v, u) for i, m in masks.items() for v, u in m], "scene string, mask_id long, v int, u int")
    got = {}
    for x in dp.morphology(px, ["scene", "mask_id"], dp.CLOSE + dp.OPEN, 30, 24).collect():
        assert x.scene == f"s{x.mask_id % 2}"
        got.setdefault(x.mask_id, set()).add((x.v, x.u))
    for i, want in masks.items():
        for what, _ in dp.CLOSE + dp.OPEN:
            near = lambda v, u: [(y, x) for y in range(max(0, v - 2), min(24, v + 3)) for x in range(max(0, u - 2), min(30, u + 3))]
            test = any if what == "dilate" else all
            want = {(v, u) for v in range(24) for u in range(30) if test(p in want for p in near(v, u))}
        assert got.get(i, set()) == want


def test_lists_of_a_batch_are_cut():
    lists = [[1, 2, 3], [4], [], [5, 6], [7, 8, 9, 10, 11], [12]]
    b = pa.RecordBatch.from_pydict({"i": list(range(6)), "x": lists})
    cut = list(blocks.slices([b], "x", 4))
    assert [c.column("i").to_pylist() for c in cut] == [[0, 1, 2], [3], [4], [5]]
    assert [c.column("x").to_pylist() for c in cut] == [lists[:3], lists[3:4], lists[4:5], lists[5:]]


@pytest.mark.parametrize("few", [1_000, 20])
def test_keys_of_few_edges_need_no_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "KEY_EDGES", few)
    if few > 100:
        monkeypatch.setattr(graph, "components", lambda *_: pytest.fail("components of small keys"))
    # A chain needs half as many rounds as it has links.
    edges = [(f"f{k}", i, i + 1) for k, n in enumerate((60, 5, 1)) for i in range(n)]
    gone = graph.greedy_removed(spark.createDataFrame(edges, "frame string, a long, b long"), ["frame"])
    got = {(x.frame, x.node) for x in gone.distinct().collect()}
    assert got == {(f"f{k}", i) for k, n in enumerate((60, 5, 1)) for i in range(1, n + 1, 2)}


class _State:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x or []

    def update(self, x):
        self.x = x

    put = update

    def appendList(self, x):
        self.x = [*(self.x or []), *x]

    def clear(self):
        self.x = None


class _Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, *_):
        return _State()

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.append(ms)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_share_a_timer():
    handle, idle = _Handle(), ordered.IdleObjects()
    idle.init(handle)
    rows = pd.DataFrame({"at": [s * 1_000_000 for s in range(100, 400)], "tie": range(300), "status": "provisional"})
    list(idle.handleInputRows(("o",), iter([rows[::-1]]), _Mark(0)))
    assert handle.timers == [100_000]
    assert not list(idle.handleExpiredTimer(("o",), _Mark(150_000), None))
    assert handle.timers[1:] == [151_000, 210_000]
    out = list(idle.handleExpiredTimer(("o",), _Mark(900_000), None))
    assert [tuple(x) for x in out[0].itertuples(index=False)] == [("o", 399_000_000, 459_000_000)]
    assert len(handle.timers) == 3


def test_claims_of_a_bucket_share_a_state_and_a_timer():
    handle, claims = _Handle(), ordered.ClaimLifetimes()
    claims.init(handle)
    rows = pd.DataFrame({"mask_id": np.arange(200), "at": np.arange(200) * 1000 + 10 ** 8, "step": 0, "action": "claim", "object_id": None})
    rows.loc[5, "action"] = "release"
    more = rows.iloc[:1].assign(at=10 ** 8 + 500_000, step=1, object_id="o", action=None)
    list(claims.handleInputRows((7,), iter([rows, more]), _Mark(0)))
    assert handle.timers == [100_000]
    assert not list(claims.handleExpiredTimer((7,), _Mark(100_300), None))
    assert handle.timers[1:] == [100_500]
    out = pd.concat(claims.handleExpiredTimer((7,), _Mark(200_000), None))
    want = {(m, e, t + us) for m, t, a in zip(rows["mask_id"], rows["at"], rows["action"]) if a == "claim" and m
            for e, us in (("stale", 500_000), ("expired", 1_000_000))}
    want |= {(0, "stale", 10 ** 8 + 1_000_000), (0, "expired", 10 ** 8 + 1_500_000)}
    assert set(zip(out["mask_id"], out["event"], out["at"])) == want and len(out) == len(want)
    assert len(handle.timers) == 2


@pytest.mark.parametrize("n, tolerance", [(3000, .11), (400, .11), (60, 2.5)])
def test_radius_counts_look_at_near_columns(n, tolerance):
    r = np.random.default_rng(n)
    a = np.round(r.uniform(-1, 1, (n, 3)) * [1, 1, .3], 2)
    b = np.concatenate([a, np.round(r.uniform(-1, 1, (n // 2, 3)), 1), a[:5]])
    want = pt._within(a, b, tolerance).sum(1)
    assert (pt._counted(a, b, tolerance) == want).all() and want.max() > 1


def test_radius_counts_copy_a_point_to_few_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(int(i % 2), i, *map(float, p)) for i, p in enumerate(r.uniform(0, 1, (3000, 3)))]
    met = []
    whole = pt.blockwise

    def seen(left, right, *args):
        met.append((left.count(), right.count()))
        return whole(left, right, *args)

    monkeypatch.setattr(pt, "blockwise", seen)
    df = spark.createDataFrame(rows, "frame_key long, point_id long, x double, y double, z double")
    got = {x.point_id: x.neighbours for x in pt.radius_counts(df, .2).collect()}
    xyz, frame = np.array([x[2:] for x in rows]), np.array([x[0] for x in rows])
    near = pt._within(xyz, xyz, .2) & (frame[:, None] == frame)
    assert got == {i: int(near[i].sum()) - 1 for i in range(len(rows))}
    assert len(met) == 1 and met[0][0] == 3000 and met[0][1] <= 3000 * 8


def test_modes_of_a_camera_are_elected_in_columns(monkeypatch):
    monkeypatch.setattr(ordered.ModeVotes, "SLICE", 7)
    handle, votes = _Handle(), ordered.ModeVotes(n=6, least_history=4, least_votes=3)
    votes.init(handle)
    r = np.random.default_rng(9)
    said = [("full", "fast", None)[k] for k in r.integers(0, 3, 150)]
    rows = pd.DataFrame({"at": np.arange(150) * 1_000_000, "frame_no": range(150), "det_id": range(150), "recommended": pd.Series(said, dtype=object)})
    got = []
    for start, end, mark in ((0, 60, 20_000), (60, 150, 100_000), (150, 150, 900_000)):
        list(votes.handleInputRows(("c",), iter([rows[start:end][::-1]]), _Mark(0)))
        got += [f for f in votes.handleExpiredTimer(("c",), _Mark(mark), None)]
    assert all(len(f) <= 7 for f in got) and len(votes.waiting.get()) == 0
    mode, want = "balanced", []
    for i in range(150):
        last = said[max(0, i - 5):i + 1]
        best = max(map(last.count, last))
        if len(last) >= 4 and best >= 3:
            mode = next(m for m in last if last.count(m) == best)
        want.append((i, mode))
    assert [tuple(x) for f in got for x in f[["det_id", "mode"]].itertuples(index=False)] == want


def test_first_look_at_neighbours_keeps_only_bounds(spark, monkeypatch):
    kept = []
    for name in ("checkpoint", "materialize"):
        monkeypatch.setattr(pt, name, lambda df, *a, f=getattr(pt, name): (kept.append(df.schema.simpleString()), f(df, *a))[1])
    r = np.random.default_rng(3)
    xyz = np.concatenate([r.uniform(0, 1, (300, 3)), r.uniform(0, .1, (200, 3)), [[.5, .5, .5]] * 12, r.uniform(0, 9, (4, 3))])
    frame = np.array([0] * 506 + [1] * 9 + [2])
    rows = [(int(f), i, *map(float, p)) for i, (f, p) in enumerate(zip(frame, xyz))] + [(0, 999, None, .5, .5)]
    df = spark.createDataFrame(rows, "frame_key long, point_id long, x double, y double, z double")
    got = {x.point_id: x.ds for x in pt.nearest_distances(df, 20, 16).collect()}
    d = np.where((frame[:, None] == frame) & ~np.eye(len(frame), dtype=bool), np.sqrt(((xyz[:, None] - xyz) ** 2).sum(2)), np.inf)
    assert got == {i: [x for x in np.sort(row)[:20] if np.isfinite(x)] for i, row in enumerate(d)} | {999: []}
    assert kept and not any("array" in x for x in kept)
