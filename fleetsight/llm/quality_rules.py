"""Quality rules as a short-circuit cascade.

Every rule names the counts it reads and rejects a text by them.  A sample of the corpus tells
for each rule how many texts it rejects and what its counts cost (array elements worked through,
the same on every machine); rules then run by rejection per cost, and a text that one rejects
is not counted for the later ones.  The verdict does not depend on the order.

Defined cases: a null or empty text has no words and fails ``few_words``; a null ``doc_id`` is
returned as null; rows that repeat are judged alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetsight.llm import bytetext as B
from fleetsight.llm.frames import batch, query, read, scan, texts

SYMBOLS = B.table(b"#*$%&|<>")
NEWLINE = B.table(b"\n")
UPPER = B.table(bytes(range(65, 91)))
LETTER = UPPER | B.table(bytes(range(97, 123)))
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


class Texts:
    """A slice of texts with its words found once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._words = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, rows: np.ndarray) -> Texts:
        if len(rows) == len(self):
            return self
        cut = [self.data[self.offsets[r]:self.offsets[r + 1]] for r in rows]
        return Texts(np.concatenate(cut) if cut else self.data[:0],
                     np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64))

    @property
    def words(self):
        if self._words is None:
            self._words = B.spans(self.data, self.offsets, B.WORD)
        return self._words

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(total[self.offsets])


def _words(t: Texts) -> dict[str, np.ndarray]:
    return {"n_words": np.diff(t.words[2]), "word_chars": t.count(B.WORD[t.data] & B.HEAD[t.data])}


def _symbols(t: Texts) -> dict[str, np.ndarray]:
    return {"n_symbols": t.count(SYMBOLS[t.data])}


def _capitals(t: Texts) -> dict[str, np.ndarray]:
    return {"n_upper": t.count(UPPER[t.data]), "n_letters": t.count(LETTER[t.data])}


def _twice(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes sorted by (row, value), and whether each equals the one before."""
    key = B.mixed(values + rows.astype(np.uint64) * _ODD)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    return order, same


def _lines(t: Texts) -> dict[str, np.ndarray]:
    starts, ends, at = B.spans(t.data, t.offsets, ~NEWLINE)
    rows = B.rows_of(at)
    filled = np.searchsorted(t.words[0], starts) < np.searchsorted(t.words[0], ends)
    starts, ends, rows = starts[filled], ends[filled], rows[filled]
    order, same = _twice(B.hashes(t.data, starts, ends), rows)
    return {"n_lines": np.bincount(rows, minlength=len(t)),
            "n_dup_lines": np.bincount(rows[order[same]], minlength=len(t))}


def _repeats(t: Texts) -> dict[str, np.ndarray]:
    starts, ends, at = t.words
    rows = B.rows_of(at)
    first = B.whole(at, 3)
    order, same = _twice(B.rolled(B.hashes(t.data, starts, ends), 3)[first], rows[first])
    member = same.copy()
    member[:-1] |= same[1:]
    hit = np.zeros(len(starts), bool)
    for j in range(3):
        hit[first[order[member]] + j] = True
    return {"n_repeat_words": np.bincount(rows[hit], minlength=len(t))}


#: Counts made together: their function, their names, and passes over (bytes, words).
GROUPS: dict[str, tuple[Callable, tuple[str, ...], tuple[int, int]]] = {
    "words": (_words, ("n_words", "word_chars"), (8, 0)),
    "symbols": (_symbols, ("n_symbols",), (3, 0)),
    "capitals": (_capitals, ("n_upper", "n_letters"), (6, 0)),
    "lines": (_lines, ("n_lines", "n_dup_lines"), (9, 2)),
    "repeats": (_repeats, ("n_repeat_words",), (4, 60)),
}
_GROUP_OF = {name: group for group, (_, names, _) in GROUPS.items() for name in names}
COUNTS = tuple(_GROUP_OF)


@dataclass(frozen=True)
class Rule:
    name: str
    reads: tuple[str, ...]
    rejects: Callable[[dict[str, np.ndarray]], np.ndarray]


#: The two rules of the base verdict come first; the order here only settles ties.
RULES = (
    Rule("few_words", ("n_words",), lambda c: c["n_words"] < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda c: 4 * c["n_symbols"] > c["n_words"]),
    Rule("word_length", ("n_words", "word_chars"),
         lambda c: (2 * c["word_chars"] < 4 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda c: 10 * c["n_dup_lines"] > 3 * c["n_lines"]),
    Rule("capitals", ("n_upper", "n_letters"), lambda c: 2 * c["n_upper"] > c["n_letters"]),
)
BASE = ("few_words", "repeated_words")


class Counts:
    """Counts of a slice, made only for the rows that ask for them."""

    def __init__(self, t: Texts):
        self.texts = t
        self.values = {name: np.zeros(len(t), np.int64) for name in COUNTS}
        self.known = {group: np.zeros(len(t), bool) for group in GROUPS}

    def of(self, names: Sequence[str], rows: np.ndarray) -> dict[str, np.ndarray]:
        for group in dict.fromkeys(_GROUP_OF[n] for n in names):
            missing = rows[~self.known[group][rows]]
            if len(missing):
                for name, v in GROUPS[group][0](self.texts.take(missing)).items():
                    self.values[name][missing] = v
                self.known[group][missing] = True
        return {name: self.values[name][rows] for name in names}


def judge(counts: Counts, rules: Sequence[Rule]) -> np.ndarray:
    """Number of the first rule that rejects each text, -1 if none does."""
    first = np.full(len(counts.texts), -1)
    for k, rule in enumerate(rules):
        alive = np.flatnonzero(first < 0)
        if len(alive):
            first[alive[rule.rejects(counts.of(rule.reads, alive))]] = k
    return first


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, share: float = 0.05,
                sample_rows: int = 1000) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost, with both figures from a sample of at most ``sample_rows``
    texts.  A rule pays for the counts that no rule before it has made."""
    names = [r.name for r in rules]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in B.pieces(b.column("text")):
                c = Counts(Texts(data, offsets))
                rows = np.arange(len(c.texts))
                bad = np.array([r.rejects(c.of(r.reads, rows)) for r in rules], bool).reshape(len(rules), len(rows))
                yield batch(rule=pa.array(np.repeat(np.arange(len(rules)), len(rows)), pa.int32()),
                            rejected=pa.array(bad.ravel().astype(np.int64)),
                            n_bytes=pa.array(np.tile(np.diff(offsets), len(rules))),
                            n_words=pa.array(np.tile(c.of(["n_words"], rows)["n_words"], len(rules))))

    sample = texts(docs).sample(share, seed=11).limit(sample_rows)
    found = {r["rule"]: r for r in scan(sample, work, "rule int, rejected long, n_bytes long, n_words long")
             .groupBy("rule").agg({"rejected": "sum", "n_bytes": "sum", "n_words": "sum", "*": "count"}).collect()}
    left, made, out = list(range(len(rules))), set(), []
    while left:
        def figures(k: int) -> tuple[float, float]:
            row = found.get(k)
            if not row or not row["count(1)"]:
                return 0.0, 1.0
            new = {_GROUP_OF[n] for n in rules[k].reads} - made
            cost = 1.0 + sum(GROUPS[g][2][0] * row["sum(n_bytes)"] + GROUPS[g][2][1] * row["sum(n_words)"] for g in new)
            return row["sum(rejected)"] / row["count(1)"], cost / row["count(1)"]
        best = max(left, key=lambda k: (figures(k)[0] / figures(k)[1], -names.index(rules[k].name)))
        out.append((rules[best], *figures(best)))
        made |= {_GROUP_OF[n] for n in rules[best].reads}
        left.remove(best)
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = (),
            sample_rows: int = 1000) -> DataFrame:
    """One row per document: ``kept``, the name of the rejecting rule (null if none), and the
    counts in ``report`` for every text (counts outside it are made only where a rule asks)."""
    ordered = [r for r, _, _ in order_rules(docs, rules, sample_rows=sample_rows)]
    base = [r for r in rules if r.name in BASE]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                c = Counts(Texts(data, offsets))
                rows = np.arange(last - first)
                by = judge(c, ordered)
                out = {"doc_id": b.column("doc_id").slice(first, last - first)}
                out |= {n: pa.array(v, pa.int64()) for n, v in c.of(list(report), rows).items()}
                if report:
                    failed = np.zeros(len(rows), bool)
                    for r in base:
                        failed |= r.rejects(c.of(r.reads, rows))
                    out["base_failed"] = pa.array(failed)
                out["kept"] = pa.array(by < 0)
                out["rejected_by"] = pa.array([ordered[k].name if k >= 0 else None for k in by], pa.string())
                yield batch(**out)

    middle = "".join(f"{n} long, " for n in report) + ("base_failed boolean, " if report else "")
    return scan(texts(docs), work, f"doc_id long, {middle}kept boolean, rejected_by string")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows and columns of ``docs`` that no rule rejects."""
    ordered = [r for r, _, _ in order_rules(docs, rules)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [judge(Counts(Texts(data, offsets)), ordered) < 0 for _, _, data, offsets in B.pieces(b.column("text"))]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return scan(docs, work, docs.schema)


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n >= 2),
v AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY 1),
c AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
 coalesce(v.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
 length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters FROM w LEFT JOIN v USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 4 * n_symbols > n_words OR 2 * word_chars < 4 * n_words OR word_chars > 15 * n_words
 OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > n_letters) AS kept FROM b"""


@query("op3_quality_rules", SQL)
def op3(spark, sf_dir):
    return cascade(read(spark, sf_dir, "documents"),
                   report=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")).drop("rejected_by")
