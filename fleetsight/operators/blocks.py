"""Comparing two large sides in bounded blocks.

Both sides of each key are cut into hashed blocks of at most about ``BLOCK`` rows, every pair of
blocks is one small task, and the task returns a few rows per left row instead of pairs.  A key
that holds a third of all rows therefore becomes many tasks of the same size, and nothing like a
cross product ever reaches the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 2048
_TASK_ROWS = 128


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Text columns as Python strings; chunked text columns do not convert back in every version."""
    text = [c for c in pdf.columns if isinstance(pdf[c].dtype, pd.StringDtype)]
    return pdf.astype({c: object for c in text}) if text else pdf


def gathered(df: DataFrame, ids: Sequence[str], columns: Sequence[str], run: Callable, schema: str) -> DataFrame:
    """``run(key, arrays)`` for every group of a size bounded by one image, many groups per batch.

    ``run`` gets the key values and a dict of numpy arrays and returns a dict of columns.  This is
    grouped pandas without its cost per group, for jobs with very many small groups.
    """
    ids, columns = list(ids), list(columns)
    rows = df.groupBy(*ids).agg(*[F.collect_list(c).alias(c) for c in columns])

    def batch(batches):
        for b in batches:
            out = [run(row[:len(ids)], dict(zip(columns, row[len(ids):])))
                   for row in b[[*ids, *columns]].itertuples(index=False, name=None)]
            out = [o for o in out if len(next(iter(o.values())))]
            if out:
                yield plain(pd.DataFrame({c: np.concatenate([np.asarray(o[c]) for o in out]) for c in out[0]}))

    return rows.mapInPandas(batch, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the lists in ``column`` hold at most ``most`` values together, or are a single one."""
    for b in batches:
        ends = b.column(column).offsets.to_numpy()
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield b.slice(start, end - start)
            start = end


def _count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _ceil_div(n: Column, d: int) -> Column:
    return F.ceil(n / F.lit(d)).cast("int")


def blockwise(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str,
              kernel: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """Apply ``kernel(left_block, right_block)`` to every pair of blocks of every shared key.

    With no keys the block counts come from two counts; with keys they come from one small
    summary per key that is joined back to both sides.
    """
    keys = list(keys)
    if not keys:
        n_left, n_right = left.count(), right.count()
        cores = left.sparkSession.sparkContext.defaultParallelism
        nl = max(1, -(-n_left // block), min(cores, -(-n_left // _TASK_ROWS)))
        nr = max(1, -(-n_right // block))
        lhs, rhs = left, right
        nl_col, nr_col = F.lit(nl), F.lit(nr)
    else:
        sizes = _count(left, keys, "_nl").join(_count(right, keys, "_nr"), keys).select(
            *keys, _ceil_div(F.col("_nl"), block).alias("_bl"),
            _ceil_div(F.col("_nr"), block).alias("_br"))
        lhs, rhs = left.join(sizes, keys), right.join(sizes, keys)
        nl_col, nr_col = F.col("_bl"), F.col("_br")

    def cut(df, own, other, own_id, own_n, other_n):
        return (df.withColumn(own, F.pmod(F.xxhash64(own_id), own_n).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), other_n - 1)))
                .drop("_bl", "_br").transform(lambda x: x.toDF(*x.columns)))

    lhs = cut(lhs, "_lb", "_rb", left_id, nl_col, nr_col)
    rhs = cut(rhs, "_rb", "_lb", right_id, nr_col, nl_col)
    group = [*keys, "_lb", "_rb"]
    return lhs.groupBy(*group).cogroup(rhs.groupBy(*group)).applyInPandas(kernel, schema)
