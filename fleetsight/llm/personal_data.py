"""Personal data by a linear-chain conditional random field over word shapes.

Fixed patterns find addresses, card numbers and telephone numbers of well-formed kinds; they are
kept as they are.  The random field labels every word of every text from the shapes of the word
and of its neighbours, and adds spans that the patterns miss (numbers without a country code
after a cue, for example).  It is trained on a small labelled table that ``labelled`` writes from
templates, and decoded by Viterbi in numpy batches.

Words whose label is settled by their own score whatever stands beside them (nearly all) cut a
text into short chains; cutting there gives the same best path as decoding the whole text.

Defined cases: null and empty texts have no spans; a null ``doc_id`` is kept; rows that repeat are
judged alike; an empty table gives an empty result; other columns are ignored (``redact``
carries them through).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm import bytetext as B
from fleetsight.llm.frames import batch, query, read, scan, texts

KINDS = ("email", "ip", "card", "phone")
_DIGIT = B.table(b"0123456789")
_ALPHA = B.table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_WORDY = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))

# The base patterns, with the bytes that their matches are made of.  No address begins inside
# a number, where it would have begun before.
PATTERNS = {
    "email": (re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), B.table(_WORDY + b"._%+-@")),
    "ip": (re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), B.table(b"0123456789.")),
    "card": (re.compile(rb"[0-9]([\x20-]?[0-9])+"), B.table(b"0123456789 -")),
    "phone": (re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]"), B.table(b"0123456789 ().-+")),
}
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _matches(kind: str, run: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches in a run of a pattern's bytes, in time linear in the run."""
    if kind != "email":
        yield from (m.span() for m in PATTERNS[kind][0].finditer(run))
        return
    begin, at = 0, run.find(b"@")
    while at >= 0:                      # what stands before an @ reaches back to the last @ or match
        m = _DOMAIN.match(run, at) if at > begin else None
        if m:
            yield begin, m.end()
        begin = m.end() if m else at + 1
        at = run.find(b"@", begin)


def luhn(digits: bytes) -> bool:
    """Check digit test of a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _valid(kind: str, found: bytes) -> bool:
    if kind == "ip":
        parts = [p.lstrip(b"0") or b"0" for p in found.split(b".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = bytes(c for c in found if 48 <= c < 58)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def base_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, end) of the patterns' spans as byte positions in the slice."""
    out = []
    at_sign = np.flatnonzero(data == 64)
    plus = np.flatnonzero(data == 43)
    dots = np.concatenate([[0], np.cumsum(data == 46, dtype=np.int64)])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    for k, kind in enumerate(KINDS):
        chars = PATTERNS[kind][1]
        if (kind == "email" and not len(at_sign)) or (kind == "phone" and not len(plus)):
            continue
        starts, ends, _ = B.spans(data, offsets, chars)
        if kind in ("email", "phone"):
            must = at_sign if kind == "email" else plus
            run = np.unique(np.searchsorted(starts, must, "right") - 1)
        elif kind == "ip":
            run = np.flatnonzero((dots[ends] - dots[starts] >= 3) & (digits[ends] - digits[starts] >= 4))
        else:
            run = np.flatnonzero(digits[ends] - digits[starts] >= 16)
        for s, e in zip(starts[run].tolist(), ends[run].tolist()):
            body = data[s:e].tobytes()
            out += [(k, s + a, s + b) for a, b in _matches(kind, body) if _valid(kind, body[a:b])]
    found = np.array(sorted(out, key=lambda x: (x[0], x[1])), np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


# Words that announce a kind of personal data.
CUES = {
    1: "email e-mail mail mailto contact write courriel correo".split(),
    2: "ip host server address addr from".split(),
    3: "card visa mastercard credit debit payment karte carte tarjeta".split(),
    4: "tel tel. phone telephone call fax mobile telefon telefono appel".split(),
}
_SIZES = (3, 9, 3, 5, 2, 2, 5)       # at, digits, letters, dots, opening, hyphen, cue
N_SHAPES = int(np.prod(_SIZES))
_PAD = N_SHAPES                      # before the first and after the last word
_STEPS = np.array([1, 3, 5, 8, 13, 16, 20])
_EDGES = B.table(b".,;:!?\"'()<>[]{}|#$%&*=")


@lru_cache(maxsize=1)
def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, c) for c, ws in CUES.items() for w in ws]
    data, offsets = B.column(pa.array([w for w, _ in words]))
    h = B.hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(h)
    return h[order], np.array([c for _, c in words])[order]


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of the shape of each word."""
    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[ends] - total[starts]

    size = ends - starts
    digit, alpha, dot, hyphen = count(_DIGIT[data]), count(_ALPHA[data]), count(data == 46), count(data == 45)
    at = count(data == 64)
    bucket = np.searchsorted(_STEPS, digit, "right")
    hex_like = (digit >= 3) & (alpha >= 3) & (at == 0)
    bucket = np.where(hex_like, 8, bucket)
    letters = np.where(alpha == 0, 0, np.where(alpha == size, 2, 1))
    if len(starts):
        lead = data[starts]
        after = data[np.minimum(starts + 1, len(data) - 1)]
        opening = (lead == 43) | ((lead == 40) & _DIGIT[after])
    else:
        opening = np.zeros(0, bool)
    cue = np.zeros(len(starts), np.int64)
    short = np.flatnonzero((size <= 12) & (alpha > 0))
    low = B.LOWER[data]
    tail = ends[short] - np.isin(data[ends[short] - 1], np.frombuffer(b":,;", np.uint8))
    h = B.hashes(low, starts[short], np.maximum(tail, starts[short]))
    known, kind = _cue_table()
    spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
    cue[short] = np.where(known[spot] == h, kind[spot], 0)
    parts = (np.minimum(at, 2), bucket, letters, np.minimum(dot, 4), opening.astype(np.int64),
             (hyphen > 0).astype(np.int64), cue)
    return np.ravel_multi_index(tuple(p.astype(np.int64) for p in parts), _SIZES)


LABELS = ("other",) + KINDS
_L = len(LABELS)
#: Blocks of features: which parts of which neighbour's shape, alone or joined.
_BLOCKS = tuple((o, (p,)) for o in (-1, 0, 1) for p in range(len(_SIZES))) + (
    (0, (1, 3)), (0, (1, 2)), (0, (0, 2, 3)), (0, (1, 4, 5)), (0, (1, 2, 3, 5)), (-1, (1, 4)), (1, (1, 5)))
_FIRST = np.concatenate([[0], np.cumsum([int(np.prod([_SIZES[p] for p in ps])) + 1 for _, ps in _BLOCKS])])


@lru_cache(maxsize=1)
def _feature_of() -> np.ndarray:
    """Feature number of each block for each shape (and for the padding)."""
    parts = np.unravel_index(np.arange(N_SHAPES), _SIZES)
    out = np.zeros((len(_BLOCKS), N_SHAPES + 1), np.int64)
    for k, (_, ps) in enumerate(_BLOCKS):
        size = tuple(_SIZES[p] for p in ps)
        out[k, :N_SHAPES] = _FIRST[k] + np.ravel_multi_index(tuple(parts[p] for p in ps), size)
        out[k, N_SHAPES] = _FIRST[k + 1] - 1
    return out


class Field:
    """Weights of the random field: features by label, and labels by label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        feature = _feature_of()
        self.tables = {o: sum(weights[feature[k]] for k, (off, _) in enumerate(_BLOCKS) if off == o) for o in (-1, 0, 1)}
        gain_in = np.maximum((moves - moves[:, :1]).max(0), 0)
        gain_out = np.maximum((moves - moves[:1, :]).max(1), 0)
        self.need = gain_in + gain_out

    def scores(self, shape: np.ndarray, at: np.ndarray) -> np.ndarray:
        before, after = np.empty_like(shape), np.empty_like(shape)
        before[1:], after[:-1] = shape[:-1], shape[1:]
        filled = at[:-1][np.diff(at) > 0]
        before[filled] = _PAD
        after[at[1:][np.diff(at) > 0] - 1] = _PAD
        return self.tables[0][shape] + self.tables[-1][before] + self.tables[1][after]

    def decode(self, shape: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Best label of each word, row by row."""
        label = np.zeros(len(shape), np.int64)
        if not len(shape):
            return label
        score = self.scores(shape, at)
        loose = ((score[:, 1:] + self.need[1:]) >= score[:, :1]).any(1)
        i = np.flatnonzero(loose)
        if not len(i):
            return label
        row = np.searchsorted(at, i, "right") - 1
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1] + 1) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(i)))
        start = i[first]
        r = row[first]
        left, right = start > at[r], start + size < at[r + 1]
        order = np.argsort(-size, kind="stable")
        start, size, left, right = start[order], size[order], left[order], right[order]
        best = score[start] + np.where(left[:, None], self.moves[0][None, :], 0)
        back = []
        for t in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -t, "left"))        # chains longer than t
            step = best[:n, :, None] + self.moves[None, :, :]
            back.append(step.argmax(1))
            best[:n] = step.max(1) + score[start[:n] + t]
        best = best + np.where(right[:, None], self.moves[:, 0][None, :], 0)
        now = best.argmax(1)
        label[start + size - 1] = now
        for t in range(int(size[0]) - 1, 0, -1):
            n = int(np.searchsorted(-size, -t, "left"))
            now[:n] = back[t - 1][np.arange(n), now[:n]]
            label[start[:n] + t - 1] = now[:n]
        return label


def labelled(n: int = 600, seed: int = 3) -> list[list[tuple[str, int]]]:
    """The small labelled table: sentences of (word, label), written from templates."""
    rng = np.random.default_rng(seed)
    plain = ("the of and report total under line was sent on der die und le la que los para with order version "
             "section page item see note value in by at year").split()
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def card() -> str:
        d = pick("3456") + digits(14)
        return d + next(c for c in "0123456789" if luhn((d + c).encode()))

    def entity() -> list[tuple[str, int]]:
        kind = int(rng.integers(0, 6))
        if kind == 0:
            word = f"{pick(('anna', 'j.roe', 'info', digits(2)))}@{pick(('mail', 'post', 'web'))}{digits(1)}.example.{pick(('com', 'org', 'de'))}"
            return ([(pick(CUES[1]), 0)] if rng.random() < 0.4 else []) + [(word + pick(("", ".", ",")), 1)]
        if kind == 1:
            word = ".".join(str(x) for x in rng.integers(1, 255, 4))
            return ([(pick(CUES[2]), 0)] if rng.random() < 0.4 else []) + [(word + pick(("", ",", ".")), 2)]
        if kind == 2:
            d = card()
            cue = [(pick(CUES[3]), 0)] if rng.random() < 0.5 else []
            return cue + ([(d, 3)] if rng.random() < 0.6 else [(d[k:k + 4], 3) for k in range(0, 16, 4)])
        if kind == 3:
            d = "+" + str(rng.integers(1, 99))
            return [(d, 4), (digits(3), 4), (digits(4), 4), (digits(3), 4)] if rng.random() < 0.5 else [(d + digits(9), 4)]
        if kind == 4:
            return [(f"({digits(3)})", 4), (f"{digits(3)}-{digits(4)}", 4)]
        return [(pick(CUES[4]), 0)] + pick(([(f"{digits(3)}-{digits(3)}-{digits(4)}", 4)], [("0" + digits(10), 4)],
                                            [("0" + digits(3), 4), (digits(7), 4)]))

    def distractor() -> list[tuple[str, int]]:
        return [(w, 0) for w in pick((
            [digits(4)], [f"{digits(2)}.{digits(2)}"], [f"{digits(1)}.{digits(1)}.{digits(2)}"], [f"20{digits(2)}-{digits(2)}-{digits(2)}"],
            [f"{digits(1)},{digits(3)}"], ["".join(pick("0123456789abcdef") for _ in range(40))], [digits(8)], [digits(12)],
            [f"({digits(4)})"], [f"{digits(3)}-{digits(3)}"], ["token", "="], ["call", "the"], ["from", "the"], ["card", "game"],
            ["page", digits(3), "of", digits(3)], [f"no.{digits(5)}"], [digits(2), digits(2), digits(2)],
            ["+" + digits(1)], ["a+b"], ["@" + pick(plain)], ["mail", "order"], [digits(6)], ["tel", "aviv"], ["CC", "BY-NC", "4.0."],
            ["Version", "2.0."]))]

    rows = []
    for _ in range(n):
        words: list[tuple[str, int]] = []
        for _ in range(int(rng.integers(1, 4))):
            words += [(pick(plain) + pick(("", "", "", ".", ",")), 0) for _ in range(int(rng.integers(1, 6)))]
            words += entity() if rng.random() < 0.5 else distractor()
        rows.append(words + [(pick(plain), 0) for _ in range(int(rng.integers(0, 4)))])
    return rows


def train(rows: list[list[tuple[str, int]]], steps: int = 150, rate: float = 0.15, ridge: float = 2e-3) -> Field:
    """Maximum likelihood by forward and backward sums over all sentences at once."""
    data, offsets = B.column(pa.array([" ".join(w for w, _ in r) for r in rows]))
    starts, ends, at = B.spans(data, offsets, B.WORD)
    y = np.array([k for r in rows for _, k in r])
    shape = shapes(data, starts, ends)
    before, after = np.append(_PAD, shape[:-1]), np.append(shape[1:], _PAD)
    before[at[:-1]], after[at[1:] - 1] = _PAD, _PAD
    feature = _feature_of()
    near = {-1: before, 0: shape, 1: after}
    f = np.stack([feature[k][near[o]] for k, (o, _) in enumerate(_BLOCKS)])
    w, moves = np.zeros((int(_FIRST[-1]), _L)), np.zeros((_L, _L))
    n, longest = np.diff(at), int(np.diff(at).max())
    place = at[:-1][:, None] + np.minimum(np.arange(longest), n[:, None] - 1)
    live = np.arange(longest) < n[:, None]
    seen_moves = np.zeros((_L, _L))
    inner = np.ones(len(y), bool)
    inner[at[:-1]] = False
    np.add.at(seen_moves, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    hist, hist_m = np.zeros_like(w), np.zeros_like(moves)
    for _ in range(steps):
        e = np.exp(np.clip(w[f].sum(0), -30, 30))[place]
        m = np.exp(moves)
        alpha, beta = np.zeros((len(n), longest, _L)), np.ones((len(n), longest, _L))
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, longest):
            a = (alpha[:, t - 1] @ m) * e[:, t]
            alpha[:, t] = np.where(live[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
        pair = np.zeros((_L, _L))
        for t in range(longest - 2, -1, -1):
            go = live[:, t + 1, None]
            right = e[:, t + 1] * beta[:, t + 1]
            b = right @ m.T
            beta[:, t] = np.where(go, b / b.sum(1, keepdims=True), 1)
            joint = alpha[:, t, :, None] * m[None] * right[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pair += joint[live[:, t + 1]].sum(0)
        post = alpha * beta
        post = (post / post.sum(2, keepdims=True))[live]
        diff = -post
        diff[np.arange(len(y)), y] += 1
        g = np.zeros_like(w)
        for k in range(len(f)):
            np.add.at(g, f[k], diff)
        g, gm = g / len(n) - ridge * w, (seen_moves - pair) / len(n) - ridge * moves
        hist += g * g
        hist_m += gm * gm
        w += rate * g / np.sqrt(hist + 1e-8)
        moves += rate * gm / np.sqrt(hist_m + 1e-8)
    return Field(w, moves)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled())


def added_spans(field: Field, data: np.ndarray, offsets: np.ndarray, base: tuple) -> list[tuple[int, int, int]]:
    """Spans of the random field that touch no span of the patterns."""
    starts, ends, at = B.spans(data, offsets, B.WORD)
    label = field.decode(shapes(data, starts, ends), at)
    hit = np.flatnonzero(label)
    if not len(hit):
        return []
    row = np.searchsorted(at, hit, "right") - 1
    _, base_start, base_end = base
    order = np.argsort(base_start)
    base_start, reach = base_start[order], np.maximum.accumulate(base_end[order]) if len(order) else base_end
    out, k = [], 0
    while k < len(hit):
        last = k
        kind = int(label[hit[k]])
        while kind >= 3 and last + 1 < len(hit) and hit[last + 1] == hit[last] + 1 and row[last + 1] == row[k] \
                and label[hit[last + 1]] == kind:
            last += 1
        s, e = int(starts[hit[k]]), int(ends[hit[last]])
        k = last + 1
        while e > s and _EDGES[data[e - 1]]:
            e -= 1
        while e > s and _EDGES[data[s]] and not (data[s] == 40 and 41 in data[s:e]):
            s += 1
        found = data[s:e].tobytes()
        digits = sum(48 <= c < 58 for c in found)
        fits = (b"@" in found and b"." in found, found.count(b".") == 3 and digits >= 4,
                13 <= digits <= 19, 7 <= digits <= 15)[kind - 1]
        spot = int(np.searchsorted(base_start, e)) - 1
        if fits and not (spot >= 0 and reach[spot] > s):
            out.append((kind - 1, s, e))
    return out


def find(field: Field, data: np.ndarray, offsets: np.ndarray):
    """(row, kind, start, end, from a pattern) of all spans, as byte positions in their text."""
    base = base_spans(data, offsets)
    more = np.array(added_spans(field, data, offsets, base), np.int64).reshape(-1, 3)
    kind, start, end = (np.concatenate([b, m]) for b, m in zip(base, more.T))
    fixed = np.arange(len(kind)) < len(base[0])
    row = np.searchsorted(offsets, start, "right") - 1
    order = np.lexsort((start, kind, row))
    return row[order], kind[order], start[order], end[order], fixed[order]


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: counts and hash of the patterns' spans, and all spans as text
    ``kind:start:end`` in code points."""
    field = field or default_field()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                n = last - first
                row, kind, start, end, fixed = find(field, data, offsets)
                point = np.concatenate([[0], np.cumsum(B.HEAD[data], dtype=np.int64)])
                begin = point[offsets[row]]
                start, end = point[start] - begin, point[end] - begin
                all_spans, base = [[] for _ in range(n)], [[] for _ in range(n)]
                for r, k, s, e, f in zip(row.tolist(), kind.tolist(), start.tolist(), end.tolist(), fixed.tolist()):
                    text = f"{KINDS[k]}:{s}:{e}"
                    all_spans[r].append(text)
                    if f:
                        base[r].append(text)
                out = {"doc_id": b.column("doc_id").slice(first, n)}
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"] = pa.array(np.bincount(row[fixed & (kind == k)], minlength=n), pa.int64())
                out["base_sha256"] = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in base], pa.string())
                out["spans"] = pa.array([",".join(x) for x in all_spans], pa.string())
                yield batch(**out)

    return scan(texts(docs), work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                "base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The same rows and columns with each span of ``text`` replaced by its kind in brackets."""
    field = field or default_field()
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text")
            done = []
            for first, last, data, offsets in B.pieces(column):
                row, kind, start, end, _ = find(field, data, offsets)
                order = np.argsort(start, kind="stable")
                spans: dict[int, list] = {}
                for i in order.tolist():
                    spans.setdefault(int(row[i]), []).append((int(start[i]), int(end[i]), KINDS[kind[i]]))
                raw = data.tobytes()
                for r in range(last - first):
                    at, parts = int(offsets[r]), []
                    for s, e, name in spans.get(r, ()):
                        if e > at:
                            parts += [raw[at:max(at, s)], f"[{name.upper()}]".encode()]
                            at = e
                    parts.append(raw[at:offsets[r + 1]])
                    done.append(b"".join(parts).decode("utf-8", "replace"))
            text = pa.array([d if ok else None for d, ok in zip(done, column.is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([text if n == "text" else b.column(i) for i, n in enumerate(b.schema.names)],
                                             names=b.schema.names)

    return scan(docs, work, schema)


@query("op8_personal_data")
def op8(spark, sf_dir):
    return personal_data(read(spark, sf_dir, "documents"))
