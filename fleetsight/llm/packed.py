"""Rows packed as bytes, so that a shuffle moves a few large rows instead of many small ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm import bytetext as B

_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_ZSTD) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def narrow(values: np.ndarray, least: int = 0) -> tuple[bytes, int]:
    """Little-endian unsigned integers, minus ``least``, in as few bytes as the largest needs."""
    v = np.ascontiguousarray((values - values.dtype.type(least)).astype("<u8"))
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return v.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def widen(body: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(n, width)
    return out.view("<u8").ravel()


def spread(ids: np.ndarray, parts: int) -> np.ndarray:
    """A chunk number for each id."""
    return (B.mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(33)) % np.uint64(parts)


def runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal keys."""
    if len(sorted_keys):
        cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
        yield from zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(sorted_keys)).tolist())


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; sizes the number of buckets."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut to about ``most`` bytes of text."""
    held, size = [], 0
    for b in batches:
        _, offsets = B.column(b.column("text"))
        for first, last in B.slices(offsets, most):
            held.append(b.slice(first, last - first))
            size += int(offsets[last] - offsets[first])
            if size >= most:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    table = pa.Table.from_batches(parts).combine_chunks()
    return table.to_batches()[0] if table.num_rows else parts[0]


def complete_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by ``key``, recut so that no key is in two of them.  A key is never cut:
    callers bound the rows of a key by the shuffle before."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(key))
        if held and keys[0] != held[-1].column(key)[0].as_py():
            yield _joined(held)
            held = []
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            yield _joined([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield _joined(held)
