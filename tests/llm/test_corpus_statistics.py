"""Spelling variants, collocations and merged transforms against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from fleetsight.llm import bwt_dedup, collocations, spelling
from fleetsight.llm import bytetext as B

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Merged transforms

def slow_repeats(rows, width=50):
    """(bytes, removed, spans, hash) of each row."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for j in range(len(b) - width + 1):
                w = b[j:j + width]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - width + 1) if i is not None else ():
            if first[b[j:j + width]] < i:
                gone[j:j + width] = [True] * width
        spans = sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _repeats(frame, **more):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in bwt_dedup.remove_repeats(frame, **more).select(*cols).collect()), key=repr)


def passages(seed, n=60):
    """Texts that share passages, with one passage in every third and texts of one letter."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    shared = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, shared[0])
        if i % 2:
            parts.insert(r.randint(0, 3), r.choice(shared))
        rows.append((i if i % 17 else None, "\n".join(parts)))
    rows += [(100, "x" * 900), (101, "x" * 700), (102, "x" * 49), (103, ""), (104, None), (7, rows[7][1]), (7, rows[9][1])]
    return rows


def test_removed_bytes_against_a_loop(spark):
    rows = passages(1)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(slow_repeats(rows), key=repr)
    assert _repeats(frame) == want
    # small ranges make every key crowded: windows go by pairs of symbols and at last each by itself
    assert _repeats(frame, range_bytes=64, chunk_bytes=2048) == want
    spans = {r["doc_id"]: r for r in bwt_dedup.remove_repeats(frame, intervals=True).where("n_spans > 1").collect()}
    assert all(sum(b - a for a, b in r["intervals"]) == r["n_removed"] for r in spans.values())


def test_removed_bytes_of_other_widths(spark):
    rows = passages(2, 30)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert _repeats(frame, width=32, symbol=8) == sorted(slow_repeats(rows, 32), key=repr)


def test_merge_orders_suffixes_as_a_sort_does():
    r = np.random.default_rng(3)
    rows, rounds = r.integers(0, 3, (400, 4)).astype(np.uint32), 4
    shard = np.sort(r.integers(0, 5, 400))
    merged = bwt_dedup.merge(shard, lambda which, k: rows[which][:, rounds - 1 - k], rounds)
    got = [tuple(rows[i]) for i in merged.row]
    assert got == sorted(got)
    sizes = Counter(map(tuple, rows.tolist()))
    assert sorted(got) == sorted(k for k, n in sizes.items() for _ in range(n) if n > 1)
    blocks = defaultdict(set)
    for g, b in zip(got, merged.block):
        blocks[b].add(g)
    assert all(len(v) == 1 for v in blocks.values()) and len(blocks) == sum(n > 1 for n in sizes.values())


def test_repeats_of_odd_and_empty_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert [r[1:] for r in _repeats(odd)] == [r[1:] for r in sorted(slow_repeats(rows), key=repr)]
    assert bwt_dedup.remove_repeats(empty).collect() == []


# Collocations

def slow_collocations(rows, longest=5, least=100, share=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, longest + 1):
                    if i + k <= len(w):
                        f[lang, tuple(w[i:i + k])] += 1
    longer = Counter()
    for (lang, w), c in f.items():
        if c >= least:
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    longer[lang, w[i:i + k]] = max(longer[lang, w[i:i + k]], c)
    found = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least and 100 * longer[lang, w] < share * a:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                        for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items()
            for k, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def test_collocations_against_a_loop(spark):
    r = random.Random(5)
    words = ["the", "of", "new", "York", "é", "city", "and", "x" * 300, "\x00a"]
    rows = [(r.choice(["en", "de", None]), "".join(r.choice(words) + r.choice([" ", " ", "\t ", " ", ". ", ",", "\n"])
                                                    for _ in range(r.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, None), ("en", " \t\n"), *[("fr", "one two three four five six")] * 120]
    frame = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS w1", "2 AS c", "3 AS level")
    for least, share, top in ((100, 100, 2000), (20, 70, 15), (5, 100, 2000)):
        got = {tuple(x) for x in collocations.collocations(frame, least=least, share=share, top=top).collect()}
        assert got == slow_collocations(rows, least=least, share=share, top=top)


def test_scores_beyond_64_bits(spark):
    rows = [(10 ** 13 + 7, 3 * 10 ** 13 + 1, 10 ** 13 + 9, 10 ** 13 + 11), (100, 10 ** 17, 100, 101), (3, 7, 2, 5)]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [x[0] for x in frame.select(collocations.floor_score("a", "n", "l", "r")).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_collocations_of_odd_and_empty_rows(spark, odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    got = {tuple(x) for x in collocations.collocations(odd, least=2).collect()}
    assert got == slow_collocations(rows, least=2)
    assert collocations.collocations(empty).collect() == []


# Spelling variants

def slow_vocabulary(rows, shortest=7, typos=31):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % typos == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def slow_variants(words, ratio=10):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def variant_rows(seed=9):
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(7, 10))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(30):
            w = list(r.choice(stems))
            if r.random() < 0.2:
                at = r.randrange(len(w))
                w[at:at + 1] = r.choice([[], ["b"], [w[at], "é"]])
            words.append("".join(w).capitalize())
        rows.append((i if i % 11 else None, r.choice([" ", "7", "×", "-"]).join(words)))
    return rows + [(200, None), (201, ""), (202, "ß" * 7 + " " + "ß" * 7 + " Ü" + "ab" * 200 + " Ü" + "ab" * 200)]


def test_variants_against_a_loop(spark):
    rows = variant_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS key").repartition(3)
    words = slow_vocabulary(rows)
    want = slow_variants(words)
    assert len(want) > 100 and any(r[2] != r[0] for r in want)
    for most in (2000, 3):                            # 3: nearly every context is cut down to single code points
        assert {tuple(r) for r in spelling.variants(frame, most=most).collect()} == want


def test_chains_of_forms(spark):
    words = [("aaaaaaa", 10 ** 6), ("aaaaaab", 10 ** 5), ("aaaaabb", 10 ** 4), ("aaaabbb", 10 ** 3), ("aaabbbb", 100), ("aabbbbb", 10)]
    frame = spark.createDataFrame([(1, " ".join(w for w, n in words for _ in range(n // 10)))], "doc_id long, text string")
    got = {r["word"]: r["root"] for r in spelling.variants(frame, least=1, typos=10 ** 9).collect()}
    assert got == {w: "aaaaaaa" for w, _ in words}


def test_acceptor_is_minimal_and_pairs_once():
    words = sorted({"tap", "taps", "top", "tops", "top", "", "sap"})
    a = spelling.Acceptor(words)
    assert sorted(a.common(a.start, a.start)) == words and len(a.arcs) == 7
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.choice([4, 5]))) for _ in range(40)})
    pairs = list(spelling.Acceptor(words).pairs(5, ""))
    assert len(pairs) == len(set(map(frozenset, pairs)))
    assert set(map(frozenset, pairs)) == {frozenset((x, y)) for x in words for y in words if len(x) == 5 and x != y and one_edit(x, y)}


def test_checksums():
    data, offsets = B.column(pa.array(["12:abc", "é", "", "z" * 700]))
    state = np.array([zlib.crc32(b"q"), 0, zlib.crc32(b"7:"), 5], np.uint32)
    got = spelling.crc32(data, offsets[:-1], offsets[1:], state)
    assert got.tolist() == [zlib.crc32(b"12:abc", zlib.crc32(b"q")), zlib.crc32("é".encode()), zlib.crc32(b"7:"), zlib.crc32(b"z" * 700, 5)]


def test_variants_of_odd_and_empty_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in spelling.variants(odd).collect()} == slow_variants(slow_vocabulary(rows))
    assert spelling.variants(empty).collect() == []
