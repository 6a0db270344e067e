"""Toxicity grades by cumulative-link ordinal regression.

A text's sparse features are the words and word stems it contains.  One weight vector gives a text its level;
ordered thresholds cut the level into grades, ``P(grade <= k) = sigmoid(threshold_k - level)``, so
all grades share the weights.  The expected grade is the severity.  Weights and thresholds are
fitted together by proximal gradient steps; an L1 term leaves few words with a weight, and only
those are looked up when the corpus is scored.

Where labels only tell toxic from clean, ``grades`` makes severity grades of them: the words
that mark toxic labelled texts are found by their odds, and a toxic text is graded by how often it
uses them (once; two or three times; more).  Words are counted in Spark; only those that tell toxic from
clean are fitted.  The sample has at most ``max_docs`` labelled
documents (those with the smallest hashed ids) outside the held-out fold.

Defined cases: null and empty texts have no words and the base severity; a null ``doc_id`` is
scored; repeated labels count by their largest value, null labels not at all; without labelled
rows or with one class only the severity is 0 for all; rows that repeat are scored alike; an empty
table gives an empty result; other columns are ignored.
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
from fleetsight.llm.passage_quality import held_out

MAX_DOCS = 20_000
_BITS = 20
STEM = 5
#: A word is learned from if so many sampled texts have it, and if its share of toxic and of clean
#: texts differs by so many standard errors.
LEAST_DOCS, SCREEN = 3, 3.0
#: Chance from which a text counts as toxic; clean held-out texts stay well below it.
TOXIC = 0.3


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, hashes of their stems, and the first word of each text.  A stem is a
    word's first bytes with the length of the whole word; it covers rare words of one family."""
    low = B.LOWER[data]
    starts, ends, at = B.spans(low, offsets, B.ALNUM)
    stem = B.hashes(low, starts, np.minimum(ends, starts + STEM), seed=1)
    return B.hashes(low, starts, ends), B.mixed(stem + (ends - starts).astype(np.uint64)), at


@dataclass
class Model:
    words: np.ndarray        # sorted hashes of the words with a weight
    weights: np.ndarray
    thresholds: np.ndarray   # ascending, one fewer than grades

    def __post_init__(self):
        self.flags = np.zeros(1 << _BITS, bool)
        self.flags[(self.words >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def levels(self, words: np.ndarray, stems: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of the weights of the distinct words and stems of each text."""
        return self._levels(words, at) + self._levels(stems, at)

    def _levels(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at) - 1)
        if not len(self.words) or not len(h):
            return out
        i = np.flatnonzero(self.flags[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.words, h[i]), len(self.words) - 1)
        ok = self.words[spot] == h[i]
        i, spot = i[ok], spot[ok]
        row = np.searchsorted(at, i, "right") - 1
        pair = np.unique(row * len(self.words) + spot)
        return np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], len(at) - 1)

    def chances(self, level: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        below = _sigmoid(self.thresholds[None, :] - level[:, None])
        edge = np.ones((len(level), 1))
        return np.diff(np.concatenate([0 * edge, below, edge], axis=1), axis=1)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def fit(bags: list[np.ndarray], grade: np.ndarray, n_grades: int = 4, least_docs: int = LEAST_DOCS, steps: int = 400,
        rate: float = 0.3, l1: float = 4e-4) -> Model:
    """Cumulative-link regression on the distinct words of each text."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(max(1, n_grades - 1), 40.0))
    if not len(grade) or grade.max() == grade.min():
        return none
    flat = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    words, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count >= least_docs
    number = np.cumsum(often) - 1
    keep = often[which]
    row, col, words = row[keep], number[which[keep]], words[often]
    n = len(grade)
    share = np.clip([(grade <= k).mean() for k in range(n_grades - 1)], 1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(len(theta)))
    first, gaps = theta[0], np.log(np.diff(theta) + 1e-3)
    w = np.zeros(len(words))
    hist, hist_t = np.full(len(words), 1e-8), np.full(n_grades - 1, 1e-8)
    for _ in range(steps):
        theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
        s = np.bincount(row, w[col], n)
        edges = np.concatenate([[-40.0], theta, [40.0]])
        up, low = _sigmoid(edges[grade + 1] - s), _sigmoid(edges[grade] - s)
        p = np.maximum(up - low, 1e-9)
        fu, fl = up * (1 - up), low * (1 - low)
        ds = (fu - fl) / p / n
        g = np.bincount(col, ds[row], len(words))
        dtheta = np.zeros(n_grades + 1)
        np.add.at(dtheta, grade + 1, -fu / p / n)
        np.add.at(dtheta, grade, fl / p / n)
        dtheta = dtheta[1:-1]
        after = np.cumsum(dtheta[::-1])[::-1]
        dt = np.concatenate([[after[0]], after[1:] * np.exp(gaps)])
        hist += g * g
        hist_t += dt * dt
        pace = rate / np.sqrt(hist)
        w = w - pace * g
        w = np.sign(w) * np.maximum(np.abs(w) - pace * l1, 0)
        step = rate * dt / np.sqrt(hist_t)
        first, gaps = first - step[0], np.clip(gaps - step[1:], -6, 6)
    theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
    used = np.abs(w) > 1e-6
    return Model(words[used], w[used], theta)


def marking(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, least: int = 4, odds: float = 8.0) -> np.ndarray:
    """Words whose presence multiplies the odds of the toxic label by ``odds`` at least; the
    arguments count the toxic and clean texts with the word, and all."""
    return (bad >= least) & ((bad + 0.5) / (good + 0.5) >= odds * max(1, n_bad) / max(1, n_good))


def grades(uses: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for clean texts; toxic ones by their uses of marking words."""
    return np.where(toxic, 1 + (uses >= 2) + (uses >= 4), 0)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", graded: bool = False,
          max_docs: int = MAX_DOCS) -> Model:
    """Fit on a bounded sample; ``graded``: the label is a grade already."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))

    # ``known`` has at most ``max_docs`` rows of two numbers, so it may be broadcast.
    rows = texts(docs).join(F.broadcast(known), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                h, stems, at = _words(data, offsets)
                y = np.asarray(b.column("y").slice(first, last - first)) > 0
                own = [np.unique(np.concatenate([h[s:e], stems[s:e]])) for s, e in zip(at[:-1], at[1:])]
                words, which = np.unique(np.concatenate(own), return_inverse=True)
                bad = np.bincount(which, np.repeat(y, [len(o) for o in own]), len(words)).astype(np.int64)
                yield batch(word=words.view(np.int64), bad=bad, n=np.bincount(which, minlength=len(words)))

    n_bad, n_all = rows.agg(F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0)), F.count("*")).first()
    p, q = F.col("bad") / max(1, n_bad), (F.col("n") - F.col("bad")) / max(1, n_all - n_bad)
    both = F.col("n") / max(1, n_all)
    spread = F.sqrt(both * (1 - both) * (1 / max(1, n_bad) + 1 / max(1, n_all - n_bad)))
    told = (scan(rows, count, "word long, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_DOCS).where(F.abs(p - q) > SCREEN * spread).toArrow())
    words = np.asarray(told["word"]).view(np.uint64)
    order = np.argsort(words)
    words, bad, n = words[order], np.asarray(told["bad"])[order], np.asarray(told["n"])[order]
    marks = words[marking(bad, n - bad, n_bad, n_all - n_bad)]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                h, stems, at = _words(data, offsets)
                own, uses = [], []
                for s, e in zip(at[:-1], at[1:]):
                    own.append(np.intersect1d(np.concatenate([h[s:e], stems[s:e]]), words).tobytes())
                    uses.append(int(np.isin(h[s:e], marks).sum()))
                yield batch(doc_id=b.column("doc_id").slice(first, last - first), y=b.column("y").slice(first, last - first),
                            words=pa.array(own, pa.binary()), uses=pa.array(uses, pa.int64()))

    found = sorted(scan(rows, pick, "doc_id long, y int, words binary, uses long").collect(), key=lambda r: (r["doc_id"], r["words"]))
    bags = [np.frombuffer(r["words"], np.uint64) for r in found]
    y = np.array([r["y"] for r in found], np.int64)
    if graded:
        return fit(bags, np.maximum(y, 0), int(y.max(initial=1)) + 1)
    uses = np.array([r["uses"] for r in found], np.int64)
    return fit(bags, grades(uses, y > 0).astype(np.int64))


def score(docs: DataFrame, model: Model, threshold: float = TOXIC) -> DataFrame:
    """One row per document: expected severity, likeliest grade, chance of any grade above 0,
    and ``toxic`` where that chance is over ``threshold``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                chance = model.chances(model.levels(*_words(data, offsets)))
                yield batch(doc_id=b.column("doc_id").slice(first, last - first),
                            severity=chance @ np.arange(chance.shape[1]), grade=pa.array(chance.argmax(1).astype(np.int32)),
                            toxic_chance=1 - chance[:, 0], toxic=pa.array(1 - chance[:, 0] > threshold))

    return scan(texts(docs), work, "doc_id long, severity double, grade int, toxic_chance double, toxic boolean")


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))
