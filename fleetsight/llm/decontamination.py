"""Benchmark passages in the corpus by suffix arrays of the training shards.

A shard is a slice of a task's documents.  Its suffix array holds the word positions that can
begin a match (those whose first words occur in the benchmark), sorted by the words that follow.
Every suffix of every benchmark item is binary-searched in it; equal windows on one diagonal of
item and document join into the longest verbatim matches with their locations.

The benchmark reaches the tasks in blocks of at most ``block_words`` words, each a broadcast of
bounded size; with several blocks the corpus is read once for each and the hits are joined by
document.  Documents are never shuffled for a benchmark of one block.

Defined cases: null texts have no words; an item without words matches nothing; an item with a
null ``item_id`` marks words but is not listed; rows that repeat are judged alike; empty tables
give no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm import bytetext as B
from fleetsight.llm.frames import batch, query, read, scan, texts

WINDOW = 10
BLOCK_WORDS = 1_000_000
_BITS = 20


@dataclass
class Block:
    """Suffixes of some benchmark items, ready for the search."""
    item: np.ndarray       # number of the item of each searched suffix
    position: np.ndarray   # its first word in the item
    width: np.ndarray      # words that must agree
    low: np.ndarray        # search keys
    high: np.ndarray
    names: list            # item ids as strings (None for null)
    vocabulary: np.ndarray
    gram: int
    grams: np.ndarray


def _keys(codes: np.ndarray) -> np.ndarray:
    """Rows of word codes as byte strings that sort in the words' order."""
    return np.ascontiguousarray(codes.astype(">u4")).view(f"S{4 * codes.shape[1]}").ravel()


def make_block(names: list, item_texts: list, window: int) -> Block | None:
    data, offsets = B.column(pa.array(item_texts, pa.large_string()))
    starts, ends, at = B.spans(B.LOWER[data], offsets, B.ALNUM)
    h = B.hashes(B.LOWER[data], starts, ends)
    n = np.diff(at)
    width = np.minimum(n, window)
    suffixes = np.where(n > 0, n - width + 1, 0)
    item = np.repeat(np.arange(len(n)), suffixes)
    if not len(item):
        return None
    position = np.arange(len(item)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
    vocabulary = np.unique(h)
    codes = np.concatenate([np.searchsorted(vocabulary, h) + 1, np.zeros(window, np.int64)])
    rows = codes[(at[item] + position)[:, None] + np.arange(window)]
    beyond = np.arange(window) >= width[item][:, None]
    gram = int(min(3, width[n > 0].min()))
    begin = at[item] + position
    value = h[begin].copy()
    for j in range(1, gram):
        value = B.mixed(value) + h[begin + j]
    return Block(item, position, width[item], _keys(np.where(beyond, 0, rows)),
                 _keys(np.where(beyond, 0xFFFFFFFF, rows)), names, vocabulary, gram, np.unique(value))


def matches(block: Block, h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Longest matches as (row, first word, item, first word in the item, words)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    g = block.gram
    first = B.whole(at, g)
    if not len(first):
        return none
    value = h[first].copy()
    for j in range(1, g):
        value = B.mixed(value) + h[first + j]
    flags = np.zeros(1 << _BITS, bool)
    flags[(block.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    maybe = flags[(value >> np.uint64(64 - _BITS)).astype(np.int64)]
    first, value = first[maybe], value[maybe]
    spot = np.searchsorted(block.grams, value)
    spot[spot == len(block.grams)] = 0
    first = first[block.grams[spot] == value]
    if not len(first):
        return none
    row = np.searchsorted(at, first, "right") - 1
    place = first[:, None] + np.arange(window)
    inside = place < at[row + 1][:, None]
    words = h[np.minimum(place, len(h) - 1)]
    spot = np.searchsorted(block.vocabulary, words.ravel()).reshape(words.shape)
    spot[spot == len(block.vocabulary)] = 0
    codes = np.where(inside & (block.vocabulary[spot] == words), spot + 1, 0)
    suffix = _keys(codes)
    order = np.argsort(suffix, kind="stable")
    suffix = suffix[order]
    lo = np.searchsorted(suffix, block.low, "left")
    hi = np.searchsorted(suffix, block.high, "right")
    count = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(count)), count)
    found = order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]]
    item, p, width = block.item[which], block.position[which], block.width[which]
    x, r = first[found], row[found]
    order = np.lexsort((x, x - p, r, item))
    item, p, width, x, r = item[order], p[order], width[order], x[order], r[order]
    new = np.ones(len(x), bool)
    new[1:] = (item[1:] != item[:-1]) | (r[1:] != r[:-1]) | (x[1:] != x[:-1] + 1) | (p[1:] != p[:-1] + 1)
    cut = np.flatnonzero(new)
    n = np.diff(np.append(cut, len(x)))
    return r[cut], x[cut] - at[r[cut]], item[cut], p[cut], n + width[cut] - 1


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """Benchmark items in blocks, read from Spark one partition at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                            F.col("text").cast("string").alias("text")).where("text is not null")
    names, held, size = [], [], 0
    for r in rows.toLocalIterator():
        names.append(r["item_id"])
        held.append(r["text"])
        size += len(r["text"]) // 2 + 1
        if size >= block_words:
            block = make_block(names, held, window)
            if block:
                yield block
            names, held, size = [], [], 0
    if held:
        block = make_block(names, held, window)
        if block:
            yield block


def _words(data: np.ndarray, offsets: np.ndarray):
    low = B.LOWER[data]
    starts, ends, at = B.spans(low, offsets, B.ALNUM)
    return B.hashes(low, starts, ends), at


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, doc_start, item_id, item_start, n_words): every longest verbatim match of at
    least ``window`` words, or of a whole shorter item; starts count words from 0."""
    def work(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for b in batches:
                for first, last, data, offsets in B.pieces(b.column("text")):
                    h, at = _words(data, offsets)
                    r, x, item, p, n = matches(block, h, at, window)
                    yield batch(doc_id=b.column("doc_id").take(pa.array(r + first)), doc_start=x,
                                item_id=pa.array([block.names[i] for i in item], pa.string()), item_start=p, n_words=n)
        return run

    spark, out = docs.sparkSession, None
    schema = "doc_id long, doc_start long, item_id string, item_start long, n_words long"
    for block in blocks(benchmark, window, block_words):
        part = scan(texts(docs), work(spark.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


_DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _scan_block(shared, window: int, whole: bool):
    """Digest of each row, or, for one block of several, what the digest is made of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value if shared is not None else None
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                h, at = _words(data, offsets)
                rows, n_words = last - first, np.diff(at)
                r, x, item, _, n = matches(block, h, at, window) if block else (np.zeros(0, np.int64),) * 5
                out = {"doc_id": b.column("doc_id").slice(first, rows), "n_words": n_words}
                if whole:
                    edge = np.zeros(len(h) + 1, np.int64)
                    np.add.at(edge, at[r] + x, 1)
                    np.add.at(edge, at[r] + x + n, -1)
                    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                    listed: dict[int, set] = {}
                    for a, i in zip(r.tolist(), item.tolist()):
                        listed.setdefault(a, set())
                        if block.names[i] is not None:
                            listed[a].add(block.names[i])
                    n_hit = np.diff(hit[at])
                    out |= {"n_hit": n_hit, "n_items": pa.array([len(listed.get(a, ())) for a in range(rows)], pa.int64()),
                            "items_sha256": pa.array([hashlib.sha256(",".join(sorted(listed.get(a, ()))).encode()).hexdigest()
                                                      for a in range(rows)]), "contaminated": pa.array(n_hit > 0)}
                else:
                    names = [block.names[i] for i in item]
                    by: dict[int, tuple[list, list]] = {}
                    for a, s, m, name in zip(r.tolist(), x.tolist(), n.tolist(), names):
                        spans, items = by.setdefault(a, ([], []))
                        spans.append([s, s + m])
                        if name is not None:
                            items.append(name)
                    out |= {"digest": pa.array([hashlib.blake2b(data[offsets[a]:offsets[a + 1]].tobytes()).hexdigest()
                                                for a in range(rows)]),
                            "spans": pa.array([by.get(a, ([], []))[0] for a in range(rows)], pa.list_(pa.list_(pa.int64()))),
                            "items": pa.array([by.get(a, ([], []))[1] for a in range(rows)], pa.list_(pa.string()))}
                yield batch(**out)
    return run


def _join_blocks(n_blocks: int):
    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n_words"].iloc[0])
        edge = np.zeros(n + 1, np.int64)
        for spans in frame["spans"]:
            for s, e in spans:
                edge[s] += 1
                edge[e] -= 1
        names = sorted({x for items in frame["items"] for x in items})
        n_hit = int((np.cumsum(edge[:-1]) > 0).sum())
        row = {"doc_id": pd.array([key[0]], "Int64"), "n_words": n, "n_hit": n_hit, "n_items": len(names),
               "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "contaminated": n_hit > 0}
        out = pd.DataFrame(row)
        return out.loc[out.index.repeat(len(frame) // n_blocks)]
    return work


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, words hit, items found and their hash, ``contaminated``."""
    spark, docs = docs.sparkSession, texts(docs)
    shared = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, window, block_words)]
    if len(shared) <= 1:
        return scan(docs, _scan_block(shared[0] if shared else None, window, True), "doc_id long, " + _DIGEST)
    parts = None
    for s in shared:
        part = scan(docs, _scan_block(s, window, False),
                    "doc_id long, n_words long, digest string, spans array<array<long>>, items array<string>")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("doc_id", "digest").applyInPandas(_join_blocks(len(shared)), "doc_id long, " + _DIGEST)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows and columns of ``docs`` without those that hold a window of the benchmark."""
    def work(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for first, _, data, offsets in B.pieces(b.column("text")):
                    h, at = _words(data, offsets)
                    clean[matches(shared.value, h, at, window)[0] + first] = False
                yield b.filter(pa.array(clean))
        return run

    for block in blocks(benchmark, window, block_words):
        docs = scan(docs, work(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, width, array_to_string(ws[i:i + width - 1], ' ') AS g FROM (
 SELECT item_id, ws, least(10, len(ws)) AS width, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, width, array_to_string(ws[i:i + width - 1], ' ') AS g FROM (
 SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM bw))),
h AS MATERIALIZED (SELECT doc_id, i, dw.width, item_id FROM dw JOIN bw USING (g, width)),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op9_benchmark_decontamination", SQL)
def op9(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
