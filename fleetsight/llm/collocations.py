r"""Collocations of two to five words from one table of longest windows and its ROLLUP.

Every word of a piece leads one window: itself and the words after it in lead columns, five at
most, padded with null where the piece ends.  Only these windows are counted, in the tasks first;
Spark's ``ROLLUP`` over language and lead columns then sums them to every shorter prefix, which
gives the counts of all phrases, of all words, and of the language, from one table.

Before that, one pass adds hashed counts of words, word pairs and triples in buckets.  A pair or triple whose
bucket stays under ``least`` lies in no candidate, so a window is padded from there on.  Buckets grow
with the text up to a fixed number; the bits that go to the tasks are at most 128 MB.  Where buckets are
full they hold nothing back: all windows are counted whole, and the counts are exact at any size.

Defined cases: null and empty texts and texts without words give no phrases; a null ``lang`` is
``und``; repeated rows count each time; equal scores are ordered by count and then by phrase; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.llm import bytetext as B
from fleetsight.llm import packed as P
from fleetsight.llm.frames import batch, query, read, scan, ship
from fleetsight.session import materialize

LONGEST = 5
LEAST = 100
TOP = 2000
GROUP_BYTES = 4 << 20
LEAST_BITS = 20
MOST_BITS = 30
SLOTS = 6                  # bits of the number of slots that buckets are added up in
_ODD = np.uint64(0x9FB21C651E98DF25)
_BREAK = B.table(b".,;:!?\n\x0b\x0c\r")
_IN_WORD = ~(B.table(b" \t") | _BREAK)
_SALTS = 16
_PARTS = 64


class _Words:
    """Words of a slice of texts, with hashes that take in the language, and which words a pair joins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = B.LOWER[data]
        self.start, self.end, at = B.spans(self.data, offsets, _IN_WORD)
        self.row = B.rows_of(at)
        seed = langs[self.row]
        self.word = B.mixed(B.hashes(self.data, self.start, self.end) + seed)
        piece = np.concatenate([[0], np.cumsum(_BREAK[self.data])])[self.start]
        joined = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        self.joined = np.append(joined, False) if len(self.start) else joined[:0]
        after = np.append(self.word[1:], np.uint64(0)) if len(self.start) else self.word
        self.pair = B.mixed(self.word * _ODD + after)
        third = np.concatenate([self.word[2:], np.zeros(min(2, len(self.word)), np.uint64)])
        self.triple = B.mixed(self.pair * _ODD + third)
        self.joined_again = self.joined & np.append(self.joined[1:], np.zeros(min(1, len(self.joined)), bool))

    def text(self, which: np.ndarray) -> pa.Array:
        size = self.end[which] - self.start[which]
        before = np.concatenate([[0], np.cumsum(size)])
        body = self.data[np.repeat(self.start[which] - before[:-1], size) + np.arange(before[-1])]
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(before.astype(np.int64)), pa.py_buffer(body))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, pa.Array]]:
    for b in P.grouped(batches, GROUP_BYTES):
        names = b.column("lang")
        data, offsets = B.column(names)
        seeds = B.hashes(data, offsets[:-1], offsets[1:], 7)
        for first, last, data, offsets in B.pieces(b.column("text"), GROUP_BYTES):
            yield _Words(data, offsets, seeds[first:last]), names.slice(first, last - first)


def _buckets(bits: int):
    """(slot, body): hashed counts of words, pairs and triples of a slice, by slots of buckets."""
    slot_bits = np.uint64(bits - SLOTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, _ in _slices(batches):
            found = np.concatenate([w.word, w.pair[w.joined], w.triple[w.joined_again]]) >> np.uint64(64 - bits)
            if not len(found):
                continue
            found.sort()
            cut = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            n = np.diff(np.append(cut, len(found)))
            found = found[cut]
            slot = found >> slot_bits
            for s, e in P.runs(slot):
                body = P.pack(batch(at=np.diff(found[s:e], prepend=slot[s] << slot_bits).astype(np.uint32),
                                    n=n[s:e].astype(np.uint32)))
                yield batch(slot=pa.array([int(slot[s])], pa.int64()), body=pa.array([body], pa.binary()))

    return work


def _full(bits: int, least: int):
    """Bits of the buckets of one slot that reach ``least``."""
    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << (bits - SLOTS), np.int64)
        for body in frame["body"]:
            t = P.unpack(body)
            total[np.cumsum(np.asarray(t["at"]), dtype=np.int64)] += np.asarray(t["n"])
        return pd.DataFrame({"slot": [key[0]], "body": [np.packbits(total >= least, bitorder="little").tobytes()]})

    return work


def _windows(known, bits: int, longest: int):
    """Distinct padded windows of a slice with their counts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(known.value, np.uint8)

        def frequent(h):
            at = h >> np.uint64(64 - bits)
            return (flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for w, names in _slices(batches):
            total = len(w.start)
            if not total:
                continue
            single = frequent(w.word)
            more = w.joined.copy()
            more[more] = frequent(w.pair[more])
            more[:-1] &= single[:-1] & single[1:]
            again = w.joined_again & more
            again[again] = frequent(w.triple[again])
            length = np.ones(total, np.int64)
            on = np.ones(total, bool)
            for j in range(longest - 1):
                step = np.zeros(total, bool)
                step[:total - j] = more[j:]
                if j:
                    step[:total - j] &= again[j - 1:total - 1]
                on &= step
                length += on
            key = w.row.astype(np.uint64) * np.uint64(0)
            _, lang = np.unique(np.asarray(names.to_numpy(zero_copy_only=False), object).astype(str), return_inverse=True)
            key += lang.astype(np.uint64)[w.row] + np.uint64(1)
            for j in range(longest):
                here = np.flatnonzero(length > j)
                key[here] = B.mixed(key[here] * _ODD + w.word[here + j])
            order = np.argsort(key)
            cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            n = np.diff(np.append(cut, total))
            first = order[cut]
            for s in range(0, len(first), 1 << 16):
                lead = first[s:s + (1 << 16)]
                columns = {"lang": names.take(pa.array(w.row[lead])).cast(pa.string())}
                for j in range(longest):
                    there = length[lead] > j
                    words = w.text(lead[there] + j)
                    place = np.where(there, np.cumsum(there) - 1, 0)
                    columns[f"w{j + 1}"] = words.take(pa.array(place, pa.int64(), mask=~there)).cast(pa.string())
                yield batch(**columns, c=n[s:s + (1 << 16)].astype(np.int64))

    return work


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, words, phrase, f) of all phrases of up to ``longest`` words, single words
    too, that occur ``least`` times or more."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    bits = min(MOST_BITS, max(LEAST_BITS, int(P.text_bytes(docs)).bit_length() - 4))
    parts = (scan(docs, _buckets(bits), "slot long, body binary").groupBy("slot")
             .applyInPandas(_full(bits, least), "slot long, body binary"))
    flags = np.zeros(1 << bits >> 3, np.uint8)
    size = len(flags) >> SLOTS
    for r in parts.toLocalIterator():                    # at most 2 ** MOST_BITS bits in all
        flags[r["slot"] * size:(r["slot"] + 1) * size] = np.frombuffer(r["body"], np.uint8)
    known = spark.sparkContext.broadcast(flags.tobytes())
    lead = [f"w{j + 1}" for j in range(longest)]
    schema = "lang string, " + ", ".join(f"{c} string" for c in lead) + ", c long"
    windows = materialize(scan(docs, _windows(known, bits, longest), schema), "windows")
    # grouping_id of a prefix of k words: the last longest - k columns are summed over
    depth = F.lit(longest) - F.log2(F.grouping_id() + 1).cast("int")
    summed = (windows.where("w2 IS NOT NULL").rollup("lang", *lead).agg(F.sum("c").alias("f"), depth.alias("k"))
              .where("k > 0").where(F.element_at(F.array(*lead), F.greatest(F.col("k"), F.lit(1))).isNotNull()))
    alone = windows.where("w2 IS NULL").select("lang", *lead, F.col("c").alias("f"), F.lit(1).alias("k"))
    kept = (summed.unionByName(alone).groupBy("lang", "k", *lead).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
            .select("lang", F.slice(F.array(*lead), F.lit(1), F.col("k")).alias("words"), "f"))
    kept = materialize(kept.withColumn("phrase", F.array_join("words", " ")), "phrases")
    return windows.groupBy("lang").agg(F.sum("c").alias("n")), kept


def _salted(counts: DataFrame, part: str, value: str) -> DataFrame:
    """Counts of phrases as parts of others; a part that very many phrases share is joined in slices."""
    return counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(value),
                         F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))


def floor_score(a, n, l, r):
    """floor(1000 * a * n / (l * r)), exact."""
    a, n, l, r = (f"cast({x} as decimal(19, 0))" for x in (a, n, l, r))
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {a} * {n}) div ({l} * {r})")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = 100,
                 top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by their lowest-scoring cut, without those that ``share`` percent or
    more of the time stand inside one longer candidate."""
    totals, counts = phrase_counts(docs, longest, least)
    many = counts.where(F.size("words") > 1)
    cuts = (many.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
            .select("lang", "phrase", F.col("f").alias("a"), "k",
                    F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
                    F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"),
                    F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int").alias("salt")))
    scored = (cuts.join(_salted(counts, "first", "l"), ["lang", "first", "salt"])
              .join(_salted(counts, "rest", "r"), ["lang", "rest", "salt"])
              .join(totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["lang", "salt"])
              .withColumn("score", floor_score("a", "n", "l", "r"))
              .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    size = F.col("size")
    inner = (many.where(F.size("words") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)))
             .groupBy("lang", F.array_join(F.slice("words", F.col("at"), size), " ").alias("phrase"))
             .agg(F.max("f").alias("longer")))
    alone = (scored.join(inner, ["lang", "phrase"], "left")
             .where(f"longer IS NULL OR 100 * longer < {int(share)} * a")
             .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score",
                     F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)).alias("part")))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return (alone.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
            .where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
t AS (SELECT lang, count(*) AS n FROM s GROUP BY 1),
g AS (SELECT lang, k, ws[i:i + k - 1] AS w FROM s, range(1, 6) AS r(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, w, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.lang, f.k, f.w, f.f AS a, x.k AS cut, x.f AS l, y.f AS r, n,
 (1000::HUGEINT * f.f * n) // (x.f::HUGEINT * y.f) AS score
 FROM f JOIN f AS x ON x.lang = f.lang AND x.k < f.k AND x.w = f.w[1:x.k]
 JOIN f AS y ON y.lang = f.lang AND y.k = f.k - x.k AND y.w = f.w[x.k + 1:f.k] JOIN t ON t.lang = f.lang WHERE f.k > 1),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
i AS (SELECT lang, w[j:j + z - 1] AS w, max(f) AS longer FROM f, range(2, 5) AS q(z), range(1, 5) AS o(j)
 WHERE z < k AND j + z - 1 <= k GROUP BY ALL),
o AS (SELECT m.lang, array_to_string(m.w, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
 FROM m LEFT JOIN i ON i.lang = m.lang AND i.w = m.w WHERE longer IS NULL OR longer < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o QUALIFY rank <= 2000"""


@query("op12_collocations", SQL)
def op12(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents"))
