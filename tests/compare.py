"""Run a registered query on Spark and its SQL on DuckDB and compare the row sets."""

from __future__ import annotations

import math
import time

import duckdb

SPENT = {"spark": 0.0}
TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "item"):
        return _norm(value.item())
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir, fn, sql):
    """None if equal, else a short text."""
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    SPENT["spark"] = time.time() - start
    got = _rows(df.columns, rows)
    if sql is None:
        return None if got else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = _rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{sorted(names)}\n  spark {g}\n  duck  {w}"
    return None if got else "both empty"


def check(spark, con, sf_dir, names, queries, oracles):
    bad = {}
    for name in names:
        t = time.time()
        try:
            d = difference(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as ex:  # noqa: BLE001
            d = f"{type(ex).__name__}: {str(ex)[:1500]}"
        mark = "ok " if d is None else "BAD"
        print(f"{mark} {name:44s} {time.time() - t:6.2f}s spark {SPENT['spark']:6.2f}s{'' if oracles.get(name) else '  (no sql)'}",
              flush=True)
        if d is not None:
            print("   ", d, flush=True)
            bad[name] = d
    return bad
