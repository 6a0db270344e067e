"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded from its own
words (lengths, kinds of characters, repetition) and from the document's length and repeated word triples; a gated attention network learns from document
labels alone how much each passage counts, and the weighted passage representation is scored.

The network is fitted on all passages of at most ``max_docs`` labelled documents: those with the
smallest hashed ids, passing over what does not fit into ``max_bytes`` of text any more;
statistics for scaling come from the same sample.  Scoring reads every passage of every document.

Defined cases: a null or empty text is one passage without words; a null ``doc_id`` is scored and
not held out; repeated labels of a document count by their largest value, null labels not at all;
rows that repeat are scored alike; without labelled rows, or with one class only, every score
is the share of label 1 (0.5 without labels); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm import bytetext as B
from fleetsight.llm.frames import batch, query, read, scan, texts

PASSAGE = 64
MAX_DOCS = 2500
MAX_BYTES = 32 << 20
FOLDS = 5
_KINDS = tuple(B.table(k) for k in (
    b"#$%&*<>", b"|", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?", b"!", bytes(range(128, 256)),
    b"\n", b"@/\\_=+~^`", bytes(range(97, 123))))
N_FEATURES = len(_KINDS) + 7


def held_out(doc_id):
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of each text's first passage."""
    starts, ends, at = B.spans(data, offsets, B.WORD)
    n = np.diff(at)
    per = np.maximum(1, -(-n // PASSAGE))
    bag = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(n)), per)
    k = np.arange(bag[-1]) - bag[doc]
    first = at[doc] + k * PASSAGE
    last = np.minimum(first + PASSAGE, at[doc + 1])
    size = last - first
    x = np.zeros((len(doc), N_FEATURES), np.float32)
    if not len(starts):
        return x, bag
    lo = np.where(size > 0, starts[np.minimum(first, len(starts) - 1)], offsets[doc])
    hi = np.where(size > 0, ends[np.maximum(last - 1, 0)], lo)
    chars = np.maximum(1, hi - lo)
    for c, kind in enumerate(_KINDS):
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        x[:, c] = (total[hi] - total[lo]) / chars
    h = B.hashes(data, starts, ends)
    length = ends - starts
    words = np.maximum(1, size)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[last] - total[first]) / words

    c = len(_KINDS)
    x[:, c] = np.log1p(size)
    x[:, c + 1] = share(length)
    x[:, c + 2] = share(length <= 3)
    x[:, c + 3] = share(np.concatenate([[False], h[1:] == h[:-1]]))
    passage = np.repeat(np.arange(len(doc)), size)
    key = B.mixed(h + passage.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(h), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    x[:, c + 4] = share(same)
    row = B.rows_of(at)
    tri = B.whole(at, 3)
    key = B.mixed(B.rolled(h, 3)[tri] + row[tri].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(h), bool)
    twice = np.concatenate([[False], key[order[1:]] == key[order[:-1]]]) if len(order) else np.zeros(0, bool)
    again[tri[order[twice]]] = True
    x[:, c + 5] = share(again)
    x[:, c + 6] = np.log1p(n[doc])
    return x, bag


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents and attention weights of passages."""
        if self.constant is not None:
            return np.full(len(bag) - 1, self.constant), 1 / np.repeat(np.diff(bag), np.diff(bag))
        return _forward(self.weights, (x - self.mean) / self.scale, bag)[:2]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray):
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    doc = np.repeat(np.arange(len(bag) - 1), np.diff(bag))
    e = np.exp(e - np.maximum.reduceat(e, bag[:-1])[doc])
    alpha = e / np.add.reduceat(e, bag[:-1])[doc]
    z = np.add.reduceat(alpha[:, None] * h, bag[:-1], axis=0)
    return _sigmoid(z @ w["u"] + w["c"]), alpha, h, t, g, z, doc


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 200,
        rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Model:
    """Full-batch Adam on the cross entropy of document labels."""
    mean, scale = x.mean(0) if len(x) else np.zeros(N_FEATURES), x.std(0) + 1e-3 if len(x) else np.ones(N_FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return Model(mean, scale, {}, float(y.mean()) if len(y) else 0.5)
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"W": draw(x.shape[1], hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate),
         "a": draw(gate), "u": draw(hidden), "c": np.zeros(1)}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        p, alpha, h, t, g, z, doc = _forward(w, x, bag)
        ds = (p - y) / len(y)
        dz = ds[:, None] * w["u"]
        dalpha = (h * dz[doc]).sum(1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, bag[:-1])[doc])
        dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
        dh = (alpha[:, None] * dz[doc] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "u": z.T @ ds,
                "c": np.array([ds.sum()])}
        for k in w:
            d = grad[k] + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS,
          max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    # ``known`` has at most ``max_docs`` rows of two numbers, so it may be broadcast and its sizes collected.
    docs = texts(docs)
    sizes = (docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y")
             .agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    fits, total = [], 0
    for r in sizes:
        if total + r["n"] <= max_bytes:
            fits.append((r["doc_id"], r["y"]))
            total += r["n"]
    known = F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long, y int"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                x, bag = encode(data, offsets)
                rows = [x[s:e].astype("<f4").tobytes() for s, e in zip(bag[:-1], bag[1:])]
                yield batch(doc_id=b.column("doc_id").slice(first, last - first), y=b.column("y").slice(first, last - first),
                            x=pa.array(rows, pa.binary()))

    rows = scan(docs.join(known, "doc_id"), work, "doc_id long, y int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["x"]))
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows]
    x = np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))
    bag = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return fit(x, bag, np.array([float(r["y"] > 0) for r in rows]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, attention: bool = False) -> DataFrame:
    """One row per document: fold, score, prediction and, if asked for, its passages' weights."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                x, bag = encode(data, offsets)
                p, alpha = model.score(x.astype(float), bag)
                out = {"doc_id": b.column("doc_id").slice(first, last - first),
                       "held_out": b.column("held_out").slice(first, last - first),
                       "score": p, "predicted": pa.array((p >= threshold).astype(np.int32))}
                if attention:
                    out["attention"] = pa.array(np.split(alpha, bag[1:-1]), pa.list_(pa.float64()))
                yield batch(**out)

    return scan(texts(docs).withColumn("held_out", held_out(F.col("doc_id"))), work,
                "doc_id long, held_out boolean, score double, predicted int" + (", attention array<double>" if attention else ""))


@query("op7_quality_classifier")
def op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))
