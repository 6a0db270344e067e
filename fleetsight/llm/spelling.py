r"""Spelling variants by composing the vocabulary's acceptor with a one-edit transducer and itself.

The words of a partition form a minimised acyclic acceptor.  Its composition with the transducer
that inserts, deletes or replaces one code point, and with the acceptor again, accepts the pairs of near
words: before the edit both sides are in one state, at the edit they part, after it they read
the same labels.  Enumerating it therefore follows one path to the edit and the common labels of two states
behind it, and never looks at two words that part early and meet nowhere.

The composition is enumerated by initial state.  For pairs whose longer word has ``m`` code points and
whose first difference lies in ``lo .. hi - 1``, both words agree in the first ``lo`` and the last ``m - hi``
code points; a partition holds the words of one such context, and its acceptor begins where the shared
prefix ends.  A partition of more than ``most`` words is cut at the middle of its range, down to ranges
of one code point, which at most one word for each letter and one shorter word share.  Thus no
partition grows with the vocabulary, and each pair is accepted in exactly one.

Defined cases: null and empty texts have no words; a null ``doc_id`` drops no code points; repeated rows count
each time; among near words of equal count the smallest in code-point order is the form; words without near words
are their own root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm import bytetext as B
from fleetsight.llm import packed as P
from fleetsight.llm.frames import batch, query, read, scan, texts
from fleetsight.session import materialize

SHORTEST = 7
TYPOS = 31
RATIO = 10
MOST = 2000
GROUP_BYTES = 16 << 20
_LETTER = B.table(bytes(range(65, 91)) + bytes(range(97, 123)) + b"\xc3")
_LONG = 256
_SALTS = 16


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, going on from the CRC-32 of what stands before it."""
    step_of = _crc_table()
    out = state ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    step = 0
    while len(live):
        c = out[live]
        out[live] = step_of[(c ^ data[starts[live] + step]) & np.uint32(255)] ^ (c >> np.uint32(8))
        step += 1
        live = live[size[live] > step]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(state[i]))
    return out


def _counts(shortest: int, typos: int):
    """Words of a task's texts with their counts; one run in ``typos`` loses a code point."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in P.grouped(batches, GROUP_BYTES):
            ids = b.column("doc_id")
            known = np.asarray(ids.is_valid())
            before = np.array([zlib.crc32(b"%d:" % i) for i in np.asarray(ids.fill_null(0), np.int64).tolist()], np.uint32)
            for first, last, data, offsets in B.pieces(b.column("text")):
                shape = data.copy()
                shape[1:][data[:-1] == 0xC3] = 97
                starts, ends, at = B.spans(shape, offsets, _LETTER)
                data = B.LOWER[data]
                heads = np.concatenate([[0], np.cumsum(B.HEAD[data])])
                size = heads[ends] - heads[starts]
                long = size >= shortest
                starts, ends, size, row = starts[long], ends[long], size[long], B.rows_of(at)[long] + first
                h = crc32(data, starts, ends, before[row])
                typo = (h % np.uint32(typos) == 0) & known[row]
                changed: Counter = Counter()
                for i in np.flatnonzero(typo & (size > shortest)):
                    word = data[starts[i]:ends[i]].tobytes().decode()
                    drop = int(h[i]) % int(size[i])
                    changed[word[:drop] + word[drop + 1:]] += 1
                starts, ends = starts[~typo], ends[~typo]
                _, one, n = np.unique(B.hashes(data, starts, ends), return_index=True, return_counts=True)
                size = ends[one] - starts[one]
                place = np.concatenate([[0], np.cumsum(size)])
                body = data[np.repeat(starts[one] - place[:-1], size) + np.arange(place[-1])]
                words = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(body))
                yield batch(word=words.cast(pa.string()), n=n.astype(np.int64))
                if changed:
                    yield batch(word=pa.array(list(changed), pa.string()), n=pa.array(list(changed.values()), pa.int64()))

    return work


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words: arcs and finality of each state; 0 has no arcs made first."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""

        def settle(depth: int) -> int:
            """Give numbers to the states below ``depth``: equal ones get one number."""
            number = -1
            while len(path) > depth:
                final, arcs = path.pop()
                key = (final, tuple(arcs.items()))
                number = known.setdefault(key, len(self.arcs))
                if number == len(self.arcs):
                    self.arcs.append(arcs)
                    self.final.append(final)
                if path:
                    path[-1][1][last[len(path) - 1]] = number
            return number

        for word in words:
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            settle(shared + 1)
            path += [(False, {}) for _ in word[shared:]]
            path[-1] = (True, path[-1][1])
            last = word
        self.start = settle(0)

    def common(self, p: int, q: int) -> list[str]:
        """All that both states accept."""
        out, stack = [], [(p, q, "")]
        while stack:
            p, q, read_ = stack.pop()
            if self.final[p] and self.final[q]:
                out.append(read_)
            there = self.arcs[q]
            for label, to in self.arcs[p].items():
                other = there.get(label)
                if other is not None:
                    stack.append((to, other, read_ + label))
        return out

    def edits(self, q: int, long: int, depth: int, after: str) -> list[tuple[str, str]]:
        """Pairs that part in state ``q``, ``depth`` labels from the start: replaced in words of ``long`` labels, or
        lost from them.  ``after`` is what follows all words, so that a lost label counts at its last place only."""
        arcs = list(self.arcs[q].items())
        out = []
        for i, (a, p) in enumerate(arcs):
            for b, r in arcs[:i]:
                out += [(a + s, b + s) for s in self.common(p, r) if depth + 1 + len(s) == long]
            out += [(a + s, s) for s in self.common(p, q) if depth + 1 + len(s) == long and not (s + after).startswith(a)]
        return out

    def pairs(self, long: int, after: str) -> Iterator[tuple[str, str]]:
        known: dict[tuple[int, int], list] = {}
        stack = [(self.start, "")]
        while stack:
            q, read_ = stack.pop()
            found = known.get((q, len(read_)))
            if found is None:
                found = known[q, len(read_)] = self.edits(q, long, len(read_), after)
            for x, y in found:
                yield read_ + x, read_ + y
            for label, to in self.arcs[q].items():
                stack.append((to, read_ + label))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the partitions in sorted batches: (word, near words, largest count, its smallest word)."""
    for b in P.complete_runs(batches, "key"):
        keys = np.asarray(b.column("key").to_numpy(zero_copy_only=False), object)
        words, counts = b.column("word").to_pylist(), b.column("n").to_pylist()
        m, lo, hi = (b.column(c).to_pylist() for c in ("m", "lo", "hi"))
        out: dict[str, list] = {"word": [], "near": [], "most": [], "best": []}
        for s, e in P.runs(keys):
            if e - s < 2:
                continue
            tail = m[s] - hi[s]
            middle = {w[lo[s]:len(w) - tail]: (w, n) for w, n in zip(words[s:e], counts[s:e])}
            after = words[s][len(words[s]) - tail:][:1] if tail else ""
            best: dict[str, list] = {}
            for x, y in Acceptor(sorted(middle)).pairs(hi[s] - lo[s], after):
                for one, other in ((x, y), (y, x)):
                    word, n = middle[other]
                    old = best.get(one)
                    if old is None:
                        best[one] = [1, n, word]
                    else:
                        old[0] += 1
                        if n > old[1] or n == old[1] and word < old[2]:
                            old[1], old[2] = n, word
            for one, (near, n, word) in best.items():
                out["word"].append(middle[one][0])
                out["near"].append(near)
                out["most"].append(n)
                out["best"].append(word)
        if out["word"]:
            yield batch(word=pa.array(out["word"], pa.string()), near=pa.array(out["near"], pa.int64()),
                        most=pa.array(out["most"], pa.int64()), best=pa.array(out["best"], pa.string()))


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, typos: int = TYPOS, least: int = 2) -> DataFrame:
    """(word, n) of the words of ``shortest`` code points or more that occur ``least`` times or more."""
    return (scan(texts(docs), _counts(shortest, typos), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _ranges(rows: DataFrame, ranges) -> DataFrame:
    """Rows for each (m, lo, hi) in ``ranges``, with the key of their context."""
    return (rows.withColumn("range", F.explode(ranges)).select("word", "n", "range.*")
            .withColumn("key", F.concat_ws("/", "m", "lo", "hi", F.expr("left(word, lo)"), F.expr("right(word, m - hi)"))))


def _struct(m, lo, hi):
    return F.struct(m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def partitions(words: DataFrame, most: int = MOST) -> DataFrame:
    """Each word in the contexts in which a near word can stand, none of more than ``most`` words but those of one
    code point."""
    size = F.length("word")
    halves = [_struct(m, a, b) for m in (size, size + 1) for a, b in ((F.lit(0), F.floor(m / 2)), (F.floor(m / 2), m))]
    rows = _ranges(words, F.array(*halves))
    while True:
        hot = materialize(rows.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > most).select("key"), "contexts")
        if hot.isEmpty():
            return rows
        # a context may hold a third of all words: joined in slices
        hot = hot.select("key", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"), F.lit(True).alias("cut"))
        told = (rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(_SALTS)).cast("int"))
                .join(hot, ["key", "salt"], "left"))
        half = F.floor((F.col("lo") + F.col("hi")) / 2)
        whole, cut = told.where("cut IS NULL"), told.where("cut")
        parts = F.array(_struct(F.col("m"), F.col("lo"), half), _struct(F.col("m"), half, F.col("hi")))
        rows = materialize(whole.select("word", "n", "m", "lo", "hi", "key")
                           .unionByName(_ranges(cut.select("word", "n", parts.alias("parts")), F.col("parts"))), "contexts")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best, best_n): how many words are one edit away, and the most frequent of them."""
    dealt = partitions(words, most).repartition("key").sortWithinPartitions("key")
    return (scan(dealt, _near, "word string, near long, most long, best string").groupBy("word")
            .agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("most")).alias("m"), F.col("best").alias("w"))).alias("b"))
            .select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n")))


def variants(docs: DataFrame, shortest: int = SHORTEST, typos: int = TYPOS, least: int = 2, ratio: int = RATIO,
             most: int = MOST) -> DataFrame:
    """One row per word: its form, the root that its forms lead to, and the counts of both."""
    words = materialize(vocabulary(docs, shortest, typos, least), "vocabulary")
    found = (words.join(near_words(words, most), "word", "left")
             .withColumn("formed", F.col("best_n") >= ratio * F.col("n"))
             .select("word", F.expr("if(formed, best, null)").alias("form"), "n",
                     F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.expr("if(formed, best_n, null)").alias("form_n")))
    found = materialize(found, "forms")
    # counts grow along a chain by the ratio, so a chain is short; each round doubles the steps taken
    root = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root = materialize(root.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                   F.col("next").isNotNull().alias("moved")), "roots")
        moved = root.where("moved").isEmpty()
        root = root.select("word", "root")
        if moved:
            break
    return (found.join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
o AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM o),
h AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
  lambda c, d: xor(t[(xor(c, d) & 255) + 1], c >> 8)), 4294967295) AS h FROM b, t),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
  FROM h) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
d AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word, y.word AS near, y.n FROM d AS x JOIN d AS y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
 UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.rest
 UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.rest),
q AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM p GROUP BY 1),
s AS (SELECT p.word, min(near) AS best FROM p JOIN q ON q.word = p.word AND p.n = q.best_n GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
 FROM w LEFT JOIN q USING (word) LEFT JOIN s USING (word)),
r AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.here WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(here, step) AS root FROM r GROUP BY 1) USING (word)"""


@query("op11_spelling_variants", SQL)
def op11(spark, sf_dir):
    return variants(read(spark, sf_dir, "documents"))
