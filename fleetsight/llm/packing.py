"""Documents packed into windows by Karmarkar-Karp multiway differencing.

A task tokenizes groups of a few megabytes of text.  A document's full windows stand alone; what
is left of it is cut into equal pieces of an eighth of a window at most.  Each piece starts as a partial
partition with one filled window; the two partial partitions with the largest imbalance merge,
the fullest windows of one onto the emptiest of the other, until one partition with near-equal
windows is left.  The remainder of the group's tokens that fills no window goes to sequences of
power-of-two lengths, which need no padding.  If a window exceeds the capacity, more such
sequences are opened to take tokens away, and the differencing runs again.

Groups never leave their task: there is no shuffle, and a lost task is done again alike.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` is kept; rows that
repeat are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetsight.llm import bytetext as B
from fleetsight.llm import packed as P
from fleetsight.llm.encoding import encoder
from fleetsight.llm.frames import batch, query, read, scan, texts

CAPACITY = 4096
END_ID = 2
GROUP_BYTES = 2 << 20
#: Tokens a window that the first differencing leaves free on average, for the imbalance that remains.
SLACK = 8


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item and the windows' sums."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(windows, np.int64)
    nodes: list = list(range(len(sizes)))
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(windows, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums_spread = int(sums[-1] - sums[0])
        nodes.append((i, j, order.astype(np.int32)))
        heapq.heappush(heap, (-sums_spread, len(nodes) - 1, sums))
    _, root, total = heap[0]
    window = np.zeros(len(sizes), np.int64)
    todo = [(root, np.arange(windows, dtype=np.int32))]
    while todo:
        node, slots = todo.pop()
        if isinstance(nodes[node], int):
            window[node] = slots[-1]
            continue
        i, j, order = nodes[node]
        pairs = np.empty_like(slots)
        pairs[order] = slots
        todo += [(i, pairs), (j, pairs[::-1])]
    return window, total


def powers(n: int, capacity: int) -> list[int]:
    """Lengths whose sum is ``n``: full windows, then powers of two."""
    return [capacity] * (n // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1)
                                           if (n % capacity) >> k & 1]


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """Pieces as (document, start, length, sequence, offset) arrays for documents of these lengths."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    left = []
    for d, n in enumerate(lengths.tolist()):
        for k in range(n // capacity):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            left.append((d, n - n % capacity, n % capacity))
    total = sum(x[2] for x in left)
    windows = total // capacity
    extra = total - windows * (capacity - min(SLACK, capacity // 64))
    left.sort(key=lambda x: (-x[2], x[0]))
    while True:
        extra = min(extra, total)
        tail, items = [], []
        lengths_of_tail = powers(extra, capacity)
        need, room = iter(lengths_of_tail), 0
        number, filled = -1, 0
        for d, start, n in left:
            while n and (room or number + 1 < len(lengths_of_tail)):
                if not room:
                    room, filled, number = next(need), 0, number + 1
                m = min(n, room)
                tail.append((d, start, m, number, filled))
                start, n, room, filled = start + m, n - m, room - m, filled + m
            parts = -(-n // max(1, capacity // 8))
            for k in range(parts):
                a, b = n * k // parts, n * (k + 1) // parts
                items.append((d, start + a, b - a))
        window, sums = differencing(np.array([x[2] for x in items], np.int64), windows) if windows else (None, None)
        if not items or (windows and sums.max() <= capacity):
            break
        extra += windows * (int(sums.max()) - (total - extra) // windows + 1) if windows else total
    for d, start, m, number, offset in tail:
        out.append((d, start, m, sequence + number, offset))
    sequence += len(lengths_of_tail)
    if items:
        order = np.argsort(window, kind="stable")
        at, before = 0, -1
        for i in order.tolist():
            if window[i] != before:
                at, before = 0, window[i]
                sequence += 1
            d, start, m = items[i]
            out.append((d, start, m, sequence - 1, at))
            at += m
    return tuple(np.array(c, np.int64) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's token ids."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        base, count = TaskContext.get().partitionId() << 33, 0
        for b in P.grouped(batches, GROUP_BYTES):
            parts = [enc.encode(data, offsets) for _, _, data, offsets in B.pieces(b.column("text"))]
            ids = np.concatenate([np.insert(i, at[1:], end_id) for i, at in parts])
            lengths = np.concatenate([np.diff(at) + 1 for _, at in parts])
            first = np.concatenate([[0], np.cumsum(lengths)])
            doc, start, length, sequence, offset = pack_group(lengths, capacity)
            begin = first[doc] + start
            crc = [zlib.crc32(ids[s:s + n].astype("<u4").tobytes()) for s, n in zip(begin.tolist(), length.tolist())]
            out = {"doc_id": b.column("doc_id").take(pa.array(doc)), "start": start, "length": length,
                   "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": lengths[doc],
                   "sequence_id": base + count + sequence, "offset": offset}
            if with_ids:
                out["ids"] = pa.array([ids[s:s + n].astype(np.int32) for s, n in zip(begin, length)],
                                      pa.list_(pa.int32()))
            count += int(sequence.max()) + 1 if len(sequence) else 0
            yield batch(**out)

    return scan(texts(docs), work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long" + (", ids array<int>" if with_ids else ""))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op2_packing")
def op2(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), vocabulary_path())
