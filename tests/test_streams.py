"""Streams over several files, one a trigger, that stop and start again."""

from pyspark.sql import functions as F

from fleetsight.operators import tracking as tk
from fleetsight.sources import derive as src
from fleetsight.streaming import jobs, ordered

START = 10 ** 12               # milliseconds; event time before 1970 is behind every watermark


def _files(frame, folder, parts):
    """Write a table as several files and return a function that opens a stream on them."""
    spark, split = frame.sparkSession, frame.withColumn("_p", F.pmod(F.xxhash64("*"), F.lit(parts)))

    def add(k):
        split.filter(F.col("_p") == k).drop("_p").coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return add, stream


def test_frames_that_span_files_and_a_restart(spark, sf_dir, tmp_path):
    e = src.table(spark, sf_dir, "events")
    add, stream = _files(e, str(tmp_path / "in"), 3)
    want = {tuple(r) for r in jobs.frame_masks(e, src.EVENTS_PER_FRAME).collect()}
    add(0)
    add(1)
    part = jobs.run_complete(jobs.frame_masks(stream(), src.EVENTS_PER_FRAME), "f", str(tmp_path / "run"))
    assert {tuple(r) for r in part.collect()} != want
    add(2)
    full = jobs.run_complete(jobs.frame_masks(stream(), src.EVENTS_PER_FRAME), "f", str(tmp_path / "run"))
    assert {tuple(r) for r in full.collect()} == want
    assert len(jobs.written(spark, str(tmp_path / "run" / "out"))) >= 3


def test_edges_of_frames_that_span_files(spark, sf_dir, tmp_path):
    px = src.pixels(spark, sf_dir).filter("frame_key < 3").withColumn("ts", F.timestamp_millis(START + F.col("frame_key") * 67))
    add, stream = _files(px, str(tmp_path / "in"), 3)
    from fleetsight.operators.depth import edges
    want = {tuple(r) for r in edges(px, src.GRID_H).groupBy("frame_key").count().collect()}
    add(0)
    jobs.frame_edges(stream(), src.GRID_W, src.GRID_H, at=str(tmp_path / "run"))
    add(1)
    add(2)
    got = jobs.frame_edges(stream(), src.GRID_W, src.GRID_H, at=str(tmp_path / "run"))
    assert {tuple(r) for r in got.collect()} == want


def test_objects_are_merged_once_over_batches_and_restarts(spark, sf_dir, tmp_path):
    now = src.objects(spark, sf_dir)
    old = now.withColumn("confidence", F.lit(0.0)).withColumn("updated_at", F.col("updated_at") - F.expr("interval 1 hour"))
    add, stream = _files(now, str(tmp_path / "in"), 3)
    add(0)
    add(1)
    jobs.upkeep(stream(), old, at=str(tmp_path / "run"))
    add(2)
    got = jobs.upkeep(stream(), old, at=str(tmp_path / "run"))
    assert got.count() == now.count() == got.select("id").distinct().count()
    assert {r["id"]: r["confidence"] for r in got.collect()} == {r["id"]: r["confidence"] for r in now.collect()}


def test_all_windows_of_a_bounded_run(spark, sf_dir, tmp_path):
    e = src.table(spark, sf_dir, "events")
    add, stream = _files(e, str(tmp_path / "in"), 1)
    add(0)
    plan = lambda s: jobs.windowed_metrics(s, "1 day")
    part = jobs.run_closed(stream(), plan, "m", str(tmp_path / "run"), end=False)
    assert part.agg(F.sum("n")).first()[0] < e.count()
    got = jobs.run_closed(stream(), plan, "m", str(tmp_path / "run")).filter("event_type IS NOT NULL")
    assert got.agg(F.sum("n")).first()[0] == e.count()


# Event-time state: files in time order, rows of one moment in several files, stops and restarts

def _slices(frame, folder, cuts):
    """Write the rows of each stretch of time, the rows of its last moment split over two files, and a stream on them."""
    spark = frame.sparkSession

    def add(k):
        low, high = START + cuts[k], START + cuts[k + 1]
        for part in range(2):
            (frame.filter((F.col("ts") >= F.timestamp_millis(F.lit(low))) & (F.col("ts") < F.timestamp_millis(F.lit(high))))
             .filter(F.pmod(F.xxhash64("*"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(folder))

    def stream():
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return add, stream


def _two_runs(frame, cuts, plan, tmp_path, name):
    add, stream = _slices(frame, str(tmp_path / "in"), cuts)
    add(0)
    add(1)
    jobs.run_closed(stream(), plan, name, str(tmp_path / "run"), end=False)
    add(2)
    return jobs.run_closed(stream(), plan, name, str(tmp_path / "run"))


def test_tracks_over_files_and_a_restart(spark, tmp_path):
    from test_operators import DET, _busy, _loop_tracker
    rules = tk.Rules(match=.6, buffer=5)
    rows = _busy(5, 60, 4)
    det = spark.createDataFrame(rows, DET).withColumn("ts", F.timestamp_millis(START + F.col("frame_no") * 100))
    plan = lambda s: ordered.stream_tracks(s, rules, 100_000, "2 seconds")
    got = {r.det_id: (r.birth_id, r.state, r.hits) for r in _two_runs(det, [0, 2000, 4000, 10_000], plan, tmp_path, "t").collect()}
    want = {i: v for i, v in _loop_tracker([(f, i, (a, b, c, d)) for _, f, i, _, a, b, c, d in rows], rules).items()}
    births = {v[0]: i for i, v in sorted(want.items(), reverse=True) if v[2] == 1}
    assert got == {i: (births[t], s, h) for i, (t, s, h) in want.items()}
    # the camera has been silent for longer than lost tracks are kept: nothing is left of it
    left = spark.read.format("statestore").option("stateVarName", "tracks").load(str(tmp_path / "run" / "cp"))
    assert left.count() == 0


def test_claim_lifetimes_over_files_and_a_restart(spark, tmp_path):
    import random
    r = random.Random(4)
    rows = [(m, f"o{m % 3}", t, r.choice(["claim", "update", "update", "release"]), k)
            for k, (m, t) in enumerate(sorted((r.randrange(12), r.randrange(90) * 100) for _ in range(160)))]
    log = spark.createDataFrame(rows, "mask_id long, object_id string, ms long, action string, step long").withColumn(
        "ts", F.timestamp_millis(START + F.col("ms"))).drop("ms")
    got = {tuple(x) for x in _two_runs(log, [0, 3000, 6000, 10_000], lambda s: ordered.claim_lifetimes(s, late="4 seconds"), tmp_path, "c").collect()}
    want = set()
    for m in range(12):
        mine = sorted((t, k, a, o) for i, o, t, a, k in rows if i == m)
        for (t, _, a, o), n in zip(mine, [*mine[1:], None]):
            for event, limit in (("stale", 500), ("expired", 1000)):
                if a != "release" and (n is None or n[0] > t + limit):
                    want.add((m, o, event, (START + t + limit) * 1000))
    assert got == want


def test_idle_objects_over_files_and_a_restart(spark, tmp_path):
    import random
    r = random.Random(6)
    rows = sorted((f"o{r.randrange(6)}", r.randrange(600) * 1000, r.choice(["provisional", "provisional", "confirmed"]))
                  for _ in range(120))
    seen = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "id string, ms long, status string, tie long").withColumn(
        "ts", F.timestamp_millis(START + F.col("ms"))).drop("ms")
    got = {tuple(x) for x in _two_runs(seen, [0, 200_000, 400_000, 700_000], lambda s: ordered.idle_objects(s, late="300 seconds"), tmp_path, "i").collect()}
    want = set()
    for o in {x[0] for x in rows}:
        mine = [(t, k, s) for k, (i, t, s) in enumerate(rows) if i == o]
        for (t, _, s), n in zip(mine, [*mine[1:], None]):
            if s == "provisional" and (n is None or n[0] >= t + 60_000):
                want.add((o, (START + t) * 1000, (START + t + 60_000) * 1000))
    assert got == want


def test_modes_over_files_and_a_restart(spark, tmp_path):
    import random
    r = random.Random(8)
    rows = [(f"c{c}", n, 100 * c + n, n * 100, r.choice(["full", "fast", "minimal"])) for c in range(2) for n in range(90)]
    f = spark.createDataFrame(rows, "camera_id string, frame_no long, det_id long, ms long, recommended string").withColumn(
        "ts", F.timestamp_millis(START + F.col("ms"))).drop("ms")
    got = {tuple(x) for x in _two_runs(f, [0, 3000, 6000, 10_000], lambda s: ordered.mode_votes(s, late="4 seconds"), tmp_path, "m").collect()}
    from fleetsight.operators import telemetry as tm
    assert got == {tuple(x) for x in tm.mode_votes(f).select("camera_id", "frame_no", "det_id", "mode").collect()}


def test_incomplete_frames_leave_with_a_flag(spark, tmp_path):
    rows = [(k, v, u, 10 * v + u) for k in range(3) for v in range(3) for u in range(4) if (k, v, u) != (1, 2, 3)]
    px = spark.createDataFrame(rows, "frame_key long, v int, u int, x int").withColumn(
        "ts", F.timestamp_millis(START + F.col("frame_key") * 3000))
    got = _two_runs(px, [0, 1000, 4000, 9000], lambda s: ordered.frames(s, 4, 3, "5 seconds"), tmp_path, "f")
    full = {(r.frame_key, r.v): (list(r.x), r.complete) for r in got.collect()}
    assert full == {(k, v): ([10 * v + u if (k, v, u) != (1, 2, 3) else 0 for u in range(4)], k != 1)
                    for k in range(3) for v in range(3)}


def test_pixels_reach_their_frame_packed(spark):
    from fleetsight.operators.depth import edges
    rows = [(k, v, u, ((k or 0) * 7 + v * v * 300 + u * 90) % 4000) for k in (0, 1, 2, None) for v in range(6) for u in range(5)]
    px = spark.createDataFrame(rows + [(None, None, None, None)], "frame_key long, v int, u int, x int").withColumn(
        "ts", F.timestamp_millis(F.lit(START) + F.coalesce("frame_key", F.lit(9)) * 3000)).coalesce(1)
    packed = ordered.packed_pixels(px).collect()
    assert len(packed) == 5
    back = [(r.frame_key, *p) for r in packed for p in zip(*(memoryview(r[c]).cast("i").tolist() for c in "vux"))]
    assert sorted(back, key=str) == sorted(rows, key=str)
    one = px.filter("frame_key IS NOT NULL").withColumnRenamed("x", "depth_raw")
    whole = one.groupBy("frame_key", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("u", "depth_raw"))), lambda c: c.depth_raw).alias("depth_raw"))
    found = [sorted(tuple(r) for r in e.collect()) for e in (edges(one, 6), edges(whole, 6, whole_rows=True))]
    assert found[0] == found[1] and found[0]
