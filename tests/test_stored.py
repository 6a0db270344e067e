"""Bucketed tables, ranks by narrowing, and percentiles of many distinct values."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsight.functions.windows import order_statistics
from fleetsight.operators import objects as store, ranks
from fleetsight.sources import buckets

OBJECT = "id string, x int, created_at long, updated_at long"


def _files(path):
    return {os.path.join(b, f): os.path.getsize(os.path.join(b, f)) for b, _, names in os.walk(path) for f in names
            if f.endswith(".parquet")}


def _objects(spark, ids, x, at):
    return spark.createDataFrame([(f"o{i}", x, at, at) for i in ids], OBJECT)


def test_a_save_writes_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    first = _objects(spark, range(500), 1, 10)
    assert not buckets.exists(spark, path)
    buckets.create(first, path, buckets=16)
    assert buckets.exists(spark, path)
    before = _files(path)
    hit = buckets.save(_objects(spark, [7], 2, 20), path, buckets=16)
    after = _files(path)
    assert len(hit) == 1 and {os.path.dirname(f) for f in before.keys() ^ after.keys()} == {f"{path}/bucket={hit[0]}"}
    assert sum(n for f, n in after.items() if f not in before) < sum(before.values()) / 4
    buckets.save(_objects(spark, [7, 8, 900], 3, 5), path, buckets=16)          # older than what is stored, and a new one
    got = {r.id: (r.x, r.created_at, r.updated_at) for r in buckets.read(spark, path, first).collect()}
    assert len(got) == 501 and got["o7"] == (2, 5, 20) and got["o8"] == (1, 5, 10) and got["o900"] == (3, 5, 5)
    assert buckets.save(_objects(spark, [], 3, 5), path, buckets=16) == []


def test_a_save_cut_short_is_mended_by_another(spark, tmp_path, monkeypatch):
    path, one = str(tmp_path / "t"), str(tmp_path / "one")
    first, second, third = _objects(spark, range(100), 1, 10), _objects(spark, range(50, 150), 2, 20), _objects(spark, range(140, 160), 3, 30)
    buckets.create(first, path, buckets=8)
    # a crash after some buckets of the second save were moved into place
    numbered = second.withColumn("bucket", buckets.bucket("id", 8))
    buckets.save(numbered.filter("bucket < 3").drop("bucket"), path, buckets=8)
    for _ in range(2):
        buckets.save(second, path, buckets=8)
    buckets.save(third, path, buckets=8)
    want = store.upsert(store.upsert(first, second), third)
    key = lambda f: sorted(tuple(r) for r in f.select("id", "x", "created_at", "updated_at").collect())
    assert key(buckets.read(spark, path, first)) == key(want)
    buckets.remove(second.select("id"), path, first, buckets=8)
    assert {r.id for r in buckets.read(spark, path, first).collect()} == {f"o{i}" for i in [*range(50), *range(150, 160)]}
    buckets.create(_objects(spark, [1], 1, 1), one, buckets=8)
    buckets.remove(_objects(spark, [1], 1, 1).select("id"), one, first, buckets=8)
    assert buckets.read(spark, one, first).count() == 0


def test_points_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(f"o{i % 40}", i // 40 * 3600, float(i), None if i % 7 == 0 else 1.0, 0.0) for i in range(2000)]
    points = spark.createDataFrame(rows, "object_id string, s long, x double, y double, z double").withColumn(
        "timestamp", F.timestamp_seconds("s")).drop("s")
    buckets.append_points(points.limit(0), path, buckets=8)
    buckets.append_points(points.filter("x < 1000"), path, buckets=8)
    before = _files(path)
    buckets.append_points(points.filter("x >= 990 AND x < 1010"), path, buckets=8)
    after = _files(path)
    assert before.items() <= after.items()
    assert sum(n for f, n in after.items() if f not in before) < sum(before.values())
    got = buckets.read(spark, path, points)
    assert got.count() == 1010 and got.agg(F.sum("x")).first()[0] == sum(range(1010))


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_match_a_sort(spark, descending):
    r = np.random.default_rng(4)
    rows = [(i, None if r.random() < .02 else int(v)) for i, v in enumerate(np.concatenate(
        [r.integers(0, 10 ** 15, 600), r.integers(0, 5, 300), np.full(300, 77)]))]
    df = spark.createDataFrame(rows, "id long, v long")
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]) if descending else (x[1] is not None, x[1] or 0, x[0]))
    for offset, limit in ((0, 7), (5, 20), (640, 30), (1190, 50), (1300, 5)):
        got = [tuple(x) for x in ranks.rank_slice(df, "v", offset, limit, descending, small=40).collect()]
        assert got == order[offset:offset + limit]
    if not descending:
        for k in (1, 300, 555, 1200):
            assert sorted(map(tuple, ranks.lowest(df, "v", k, small=40).collect())) == sorted(order[:k])


def test_percentiles_of_many_distinct_values(spark):
    r = np.random.default_rng(6)
    rows = [(f"k{i % 3}", float(v)) for i, v in enumerate(r.normal(size=3000))] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: sorted(v for n, v in rows if n == k) for k in {n for n, _ in rows}}
    # few = 1: bands are cut until one value is left
    for few in (1, 10_000):
        got = {x.k: (x.a, x.b, x.c) for x in order_statistics(df, ["k"], "v", {"a": 0.0, "b": 50.0, "c": 99.0}, few).collect()}
        assert got == {k: tuple(s[min(len(s) - 1, int(len(s) * p / 100))] for p in (0, 50, 99)) for k, s in want.items()}
