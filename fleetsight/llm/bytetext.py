"""Word spans and hashes of whole columns of text, as numpy operations on their UTF-8 bytes.

Spark hands an Arrow batch to a task; these helpers see its text column as one buffer of bytes
with the offsets of its rows and never make a Python string per word.  Work goes in slices of a
few megabytes of text, so that memory stays bounded whatever the batch holds; only a single
text larger than a slice makes a larger one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_LONG = 512
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


def table(chars: bytes) -> np.ndarray:
    """256 flags: which bytes are in ``chars``."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = table(b" \t\n\x0b\x0c\r")
WORD = ~SPACE                      # [^\x20\x09-\x0D]
ALNUM = table(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
HEAD = (np.arange(256) & 0xC0) != 0x80   # bytes that begin a code point


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not pa.types.is_large_string(values.type):
        values = values.cast(pa.large_string())
    if values.null_count:
        values = pc.fill_null(values, "")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1] if len(values) \
        else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a larger row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def pieces(values: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of each slice of a text column."""
    data, offsets = column(values)
    for first, last in slices(offsets, most):
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]


def spans(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``kept`` bytes, none across rows, and for each row
    the number of its first run (with the total at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kept[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    border[0] = border[n] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last = inside
    last[:-1] &= ~(inside[1:] & ~border[1:n])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * _M1
    h ^= h >> _S32
    h *= _M2
    h ^= h >> _S32
    return h


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes a round; spans of over 512 bytes by blake2b."""
    size = ends - starts
    h = size.astype(np.uint64) * _M2 ^ np.uint64(seed)
    if not len(size):
        return h
    view = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero(size <= _LONG)
    step = 0
    while len(live):
        left = size[live] - step
        value = view[starts[live] + step]
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mixed(h[live] ^ value)
        step += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = np.frombuffer(digest.digest(), np.uint64)[0]
    return h


def rolled(h: np.ndarray, width: int, base: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Rabin-Karp value (modulo 2**64) of each run of ``width`` consecutive hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= np.uint64(base)
        out += h[j:j + n]
    return mixed(out)


def whole(at: np.ndarray, width: int) -> np.ndarray:
    """First words of the windows that lie within one row; ``at``: first word of each row."""
    total = int(at[-1])
    ok = np.ones(max(0, total - width + 1), bool)
    for j in range(1, width):
        cut = at[1:-1] - j
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return np.flatnonzero(ok)


def rows_of(at: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
