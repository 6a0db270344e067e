"""Repeated passages across documents by Rabin-Karp windows counted in Spark.

Every run of ``width`` consecutive words has a 64-bit rolling hash.  A task finds the smallest
document of each hash in a group of its documents and packs these by hash range, so that Spark
shuffles few large rows; all larger documents of the group are hits already.  A task then merges
the packs of one range, finds each hash's smallest document, and sends the hit hashes on to the
chunk of documents they belong to.  There they meet the texts, become positions again, and
repeated windows merge into maximal removal intervals.

Ranges and chunks follow the input's size, so that a task's part stays the same at any size.  A
window that a third of all documents hold is one entry for each group of ``GROUP_BYTES`` in its
range, not one for each document, and never a pair.

Defined cases: null and empty texts, and texts of fewer than ``width`` words, lose nothing; rows
with a null ``doc_id`` lose nothing and count for nobody; rows with equal ``doc_id`` do not count
for each other but are judged alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetsight.llm import bytetext as B
from fleetsight.llm import packed as P
from fleetsight.llm.frames import batch, query, read, scan, ship, texts

WIDTH = 13
GROUP_BYTES = 16 << 20


def _windows(data: np.ndarray, offsets: np.ndarray, width: int):
    starts, ends, at = B.spans(data, offsets, B.WORD)
    first = B.whole(at, width)
    return starts, ends, at, first, B.rolled(B.hashes(data, starts, ends), width)[first]


def _hash_packs(width: int, ranges: int, chunks: int):
    """(part, body).  Parts below ``ranges``: each hash of the group once, with the smallest document that
    starts it here, sorted by hash.  Parts from ``ranges`` on, one for each chunk: hashes of the group's other
    documents, which are hits whatever the rest of the table holds."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in P.grouped(batches, GROUP_BYTES):
            all_ids = b.column("doc_id")
            known = np.asarray(all_ids.is_valid())
            ids = np.asarray(all_ids.fill_null(0), np.int64)
            hs, owners = [], []
            for first_row, last_row, data, offsets in B.pieces(b.column("text")):
                _, _, at, first, h = _windows(data, offsets, width)
                row = B.rows_of(at)[first] + first_row
                ok = known[row]
                hs.append(h[ok])
                owners.append(ids[row[ok]])
            if not hs or not sum(map(len, hs)):
                continue
            h, least, sure = _settled(np.concatenate(hs), np.concatenate(owners))
            part = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            keys, bodies = [], []
            for s, e in P.runs(part):
                base, low = int(h[s]), int(least[s:e].min())
                gaps, gap_width = P.narrow(np.diff(h[s:e], prepend=h[s]))
                docs, doc_width = P.narrow(least[s:e], low)
                head = np.array([e - s, gap_width, doc_width, low], "<i8").tobytes() + np.uint64(base).tobytes()
                keys.append(int(part[s]))
                bodies.append(head + gaps + docs)
            for chunk, body in _by_chunk(*sure, chunks):
                keys.append(ranges + chunk)
                bodies.append(body)
            for k in range(0, len(keys), 64):
                yield batch(part=pa.array(keys[k:k + 64], pa.int64()), body=pa.array(bodies[k:k + 64], pa.binary()))

    return work


def _settled(h: np.ndarray, owner: np.ndarray):
    """Distinct hashes in order, the smallest owner of each, and (hash, owner) of all larger owners."""
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    least = np.minimum.reduceat(owner, cut)
    hit = owner > np.repeat(least, np.diff(np.append(cut, len(h))))
    return h[cut], least, (h[hit], owner[hit])


def _by_chunk(h: np.ndarray, owner: np.ndarray, chunks: int) -> Iterator[tuple[int, bytes]]:
    """Distinct (hash, owner), packed for each chunk of documents."""
    chunk = P.spread(owner, chunks)
    order = np.lexsort((h, owner, chunk))
    h, owner, chunk = h[order], owner[order], chunk[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[:len(h)]
    h, owner, chunk = h[new], owner[new], chunk[new]
    for s, e in P.runs(chunk):
        yield int(chunk[s]), P.pack(batch(doc_id=owner[s:e], hash=h[s:e]))


def _read_pack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, gap_width, doc_width, least = np.frombuffer(body, "<i8", 4).tolist()
    base = np.frombuffer(body, "<u8", 1, 32)[0]
    cut = 40 + n * gap_width
    h = np.cumsum(P.widen(body[40:cut], gap_width, n), dtype=np.uint64) + base
    return h, P.widen(body[cut:], doc_width, n).view(np.int64) + least


def _hits(ranges: int, chunks: int):
    """Hashes of one range that a smaller document of another group starts as well, by chunk of documents;
    what is a hit already goes on to its chunk."""
    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= ranges:
            found = [(key[0] - ranges, body) for body in frame["body"]]
        else:
            parts = [_read_pack(x) for x in frame["body"]]
            sure = _settled(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))[2]
            found = list(_by_chunk(*sure, chunks))
        return pd.DataFrame({"chunk": np.array([c for c, _ in found], np.int64), "kind": np.ones(len(found), np.int32),
                             "body": [body for _, body in found]})

    return work


def _text_packs(chunks: int):
    """Texts by chunk of documents; a chunk gets those with a null ``doc_id`` by turns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in P.grouped(batches, GROUP_BYTES):
            ids = b.column("doc_id")
            chunk = P.spread(np.asarray(ids.fill_null(0), np.int64), chunks)
            lost = ~np.asarray(ids.is_valid())
            chunk[lost] = np.arange(lost.sum(), dtype=np.uint64) % np.uint64(chunks)
            order = np.argsort(chunk, kind="stable")
            chunk = chunk[order]
            for s, e in P.runs(chunk):
                body = P.pack(b.take(pa.array(order[s:e])))
                yield batch(chunk=pa.array([int(chunk[s])], pa.int64()), kind=pa.array([0], pa.int32()),
                            body=pa.array([body], pa.binary()))

    return work


def covered(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``first``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _removal(width: int, intervals: bool):
    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hits = [P.unpack(x) for x in frame.loc[frame["kind"] == 1, "body"]]
        hash_of = np.concatenate([np.asarray(t["hash"]) for t in hits]) if hits else np.zeros(0, np.uint64)
        doc_of = np.concatenate([np.asarray(t["doc_id"]) for t in hits]) if hits else np.zeros(0, np.int64)
        mark = np.unique(B.mixed(hash_of + B.mixed(doc_of.view(np.uint64))))
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "intervals": []}
        for body in frame.loc[frame["kind"] == 0, "body"]:
            t = P.unpack(body)
            ids = t["doc_id"].combine_chunks()
            known = np.asarray(ids.is_valid())
            whole_ids = np.asarray(ids.fill_null(0), np.int64)
            for first_row, last_row, data, offsets in B.pieces(t["text"]):
                starts, ends, at, first, h = _windows(data, offsets, width)
                row = B.rows_of(at)[first] + first_row
                look = B.mixed(h + B.mixed(whole_ids[row].view(np.uint64)))
                spot = np.searchsorted(mark, look)
                spot[spot == len(mark)] = 0
                hit = known[row] & (mark[spot] == look) if len(mark) else np.zeros(len(look), bool)
                gone = covered(first[hit], width, len(starts))
                n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[at])
                raw = data.tobytes()
                for r in range(last_row - first_row):
                    words = raw[offsets[r]:offsets[r + 1]].split()
                    drop = gone[at[r]:at[r + 1]]
                    kept = [w for w, g in zip(words, drop) if not g] if n_gone[r] else words
                    out["doc_id"].append(int(whole_ids[first_row + r]) if known[first_row + r] else None)
                    out["n_words"].append(len(words))
                    out["n_removed"].append(int(n_gone[r]))
                    out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    if intervals:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                        out["intervals"].append(edge.reshape(-1, 2).tolist())
        if not intervals:
            del out["intervals"]
        out["doc_id"] = pd.array(out["doc_id"], "Int64")
        return pd.DataFrame(out)

    return work


def remove_repeats(docs: DataFrame, width: int = WIDTH, range_windows: int = 400_000,
                   chunk_bytes: int = 8 << 20, intervals: bool = False) -> DataFrame:
    """One row per document: words, removed words, the hash of the kept words joined by a space
    and, if asked for, the maximal removal intervals as pairs of word numbers."""
    docs = texts(docs)
    ship(docs.sparkSession)
    size = P.text_bytes(docs)
    ranges, chunks = max(16, size // (6 * range_windows)), max(16, size // chunk_bytes)
    hits = (scan(docs, _hash_packs(width, ranges, chunks), "part long, body binary")
            .groupBy("part").applyInPandas(_hits(ranges, chunks), "chunk long, kind int, body binary"))
    both = scan(docs, _text_packs(chunks), "chunk long, kind int, body binary").unionByName(hits)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return both.groupBy("chunk").applyInPandas(
        _removal(width, intervals), schema + (", intervals array<array<long>>" if intervals else ""))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM r),
k AS (SELECT doc_id, j, ws[j] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM d)),
o AS (SELECT k.doc_id, count(x.j) AS n_removed, string_agg(word, ' ' ORDER BY k.j) FILTER (x.j IS NULL) AS kept
 FROM k LEFT JOIN x ON x.doc_id = k.doc_id AND x.j = k.j GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""


@query("op10_substring_dedup", SQL)
def op10(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"))
