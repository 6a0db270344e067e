"""Secret scan: a random forest tells leaked credentials from look-alikes.

Candidates are runs of at least ``LEAST`` credential characters with both letters and digits
(whole texts are searched as bytes; a run ends at an assignment), and values of any characters from
``LEAST_CUED`` bytes on that are assigned to a name with a leak cue.  Each gets features of its length, of the transitions
between kinds of characters, of the share of it that dictionary words cover, of the path the
text came from, and of the words beside it.  A forest of axis-parallel trees, trained here on
a table of labelled findings, keeps the secrets and drops hashes, identifiers, file names and
examples.

The default table of findings is written by rule in ``labelled_findings``; a table of one's own
has the columns ``text`` (the candidate with its surroundings), ``start``, ``end``, ``path``, ``label``.

Defined cases: null and empty texts have no findings; a null path is an empty one; a null
``doc_id`` is kept; rows that repeat give their findings each; an empty table gives an empty result;
columns other than ``doc_id``, ``text`` and the path are ignored.
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
from fleetsight.llm import packed as P
from fleetsight.llm.frames import batch, query, read, scan

LEAST, LEAST_CUED = 16, 8
_DIGIT = B.table(b"0123456789")
_LETTER = B.table(bytes(range(65, 91)) + bytes(range(97, 123)))
_CHARS = _DIGIT | _LETTER | B.table(b"_-+/=.")
_TRIM = b"_-+/=."

# Everyday and programming words for the dictionary share, and cue words.
DICTIONARY = """the and for with from this that have not are was you all can will one file name data test user main
    page image index home list item text type value input output string number config default version release build
    debug error warning message class object method function return import export module package library server
    client request response service account project report update delete create read write open close start stop
    first last next previous section chapter figure table column row field example sample demo dummy placeholder
    change replace insert your here license public private common general system network local remote global node
    docs source target script style content template document resource static assets media video audio photo
    december january february march april june july august september october november monday friday""".split()
LEAK_CUES = """token secret password passwd pwd key apikey api_key access_key secret_key auth authorization bearer credential
    credentials client_secret private signing webhook""".split()
FALSE_CUES = """commit sha sha1 sha256 md5 checksum digest hash etag revision rev uuid guid id version build example sample
    dummy placeholder test fixture href src url img integrity nonce""".split()
TEST_PATHS = re.compile(r"test|spec|fixture|example|sample|mock|docs?(/|$)|readme|lock$", re.I)
CODE_PATHS = re.compile(r"\.(env|py|js|ts|rb|go|java|sh|ya?ml|json|ini|cfg|conf|toml|properties|tf)$|config|deploy|settings", re.I)
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PREFIX = re.compile(r"^(AKIA|ASIA|ghp_|gho_|ghs_|xox[abp]-|sk_live_|sk-|AIza|eyJ|glpat-|npm_|SG\.)")
#: A value assigned to a name with a leak cue: quoted up to its quote, else up to white space.
_CUED = re.compile(rb"(?:token|secret|passw(?:or)?d|pwd|key|auth(?:orization)?|bearer|credentials?|private|signing|webhook)[A-Za-z0-9_]{0,20}"
                   rb"[\"'`]?[ \t]*(?::=|=>|[:=])[ \t]*(?:bearer[ \t]+)?(?:\"([^\"\r\n]{8,})\"|'([^'\r\n]{8,})'|`([^`\r\n]{8,})`|([^\s\"'`]{8,}))", re.I)
_FIND = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) >= 3), key=len, reverse=True)))
FEATURES = ("length", "digits", "upper", "lower", "other", "to_digit", "to_letter", "case_changes", "distinct", "entropy",
            "hex", "uuid", "prefix", "dictionary", "separators", "longest_letters", "leak_cue", "false_cue", "assigned", "quoted",
            "test_path", "code_path", "in_path", "repeats")


def features(found: str, before: str, after: str, path: str) -> list[float]:
    """Numbers of one candidate with up to 60 characters on either side."""
    n = len(found)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in found]
    pairs = list(zip(kind, kind[1:]))
    counts = np.unique(list(found), return_counts=True)[1] / n
    low = found.lower()
    cues = [w.lower() for w in _WORD.findall(before)[-4:]]
    parts = {p for w in cues[-3:] for p in [w, *w.split("_")]}
    covered = sum(len(m) for m in _FIND.findall(low))
    runs = [len(r) for r in re.findall(r"[A-Za-z]+", found)]
    return [
        n, kind.count("d") / n, kind.count("u") / n, kind.count("l") / n, kind.count("o") / n,
        sum(a != "d" and b == "d" for a, b in pairs) / n, sum(a == "d" and b != "d" for a, b in pairs) / n,
        sum({a, b} == {"u", "l"} for a, b in pairs) / n, len(set(found)) / n,
        float(-(counts * np.log2(counts)).sum()), float(bool(re.fullmatch(r"[0-9a-fA-F]+", found))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", found))),
        float(bool(_PREFIX.match(found))), covered / n, sum(found.count(c) for c in "-_/.") / n,
        max(runs, default=0) / n, float(any(c in p for p in parts for c in LEAK_CUES if len(c) > 3) or "key" in parts or "pwd" in parts),
        float(not parts.isdisjoint(FALSE_CUES)), float(bool(re.search(r"[:=]\s*[\"'`]?$", before))),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before)),
        float(bool(TEST_PATHS.search(path))), float(bool(CODE_PATHS.search(path))),
        float(before[-1:] in "/\\." or after[:1] in "/\\"), max((found.count(found[i:i + 4]) for i in range(0, n - 4, 4)), default=1),
    ]


def labelled_findings(n: int = 1600, seed: int = 17) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, path, label) of synthetic findings, by rule."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = "the of and in to that was with report section and here is der die la les que".split()
    words = [w for w in DICTIONARY if len(w) > 3]
    code, plain = ("app/settings.py", "deploy.yaml", ".env", "src/main.js", ""), ("", "src3", "notes", "post", "crawl")
    tests = ("tests/fixtures/a.json", "docs/readme.md", "examples/demo.py", "package.lock")
    rows = []
    for i in range(n):
        secret = i % 2 == 0
        lead = " ".join(pick(prose) for _ in range(int(rng.integers(0, 8))))
        tail = " ".join(pick(prose) for _ in range(int(rng.integers(0, 6))))
        if secret:
            value = (chars(hexa, int(pick((32, 40, 40, 64)))), chars(alnum, int(rng.integers(20, 64))), "AKIA" + chars(alnum[:26] + alnum[52:], 16),
                     "ghp_" + chars(alnum, 36), chars(alnum + "+/", 43) + "=", "sk_live_" + chars(alnum, 24))[int(rng.integers(6))]
            cue = pick(("token", "secret", "api_key", "password", "auth_token", "SECRET_KEY", "access_key", "client_secret", "Authorization: Bearer"))
            glue = " " if "Bearer" in cue else pick((' = "', "=", ': "', " = '", ": "))
            if value.startswith(("AKIA", "ghp_", "sk_live_")) and rng.random() < 0.4:
                cue, glue = pick(prose), " "
            if rng.random() < 0.3:
                value = chars((alnum, alnum + "!@#$%:", alnum[:52], alnum[26:52], "0123456789")[int(rng.integers(5))], int(rng.integers(8, 16)))
                cue = pick(("password", "passwd", "PASSWORD", "db_password", "secret", "pwd", "token", "api_key"))
                glue = pick((' = "', "=", ': "', " = '", ": "))
            path = pick(code + plain)
        else:
            k = int(rng.integers(8))
            value = (chars(hexa, int(pick((32, 40, 64)))), f"{chars(hexa, 8)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 12)}",
                     "_".join(pick(words) for _ in range(4)) + chars("0123456789", 2), "/".join(pick(words) for _ in range(4)) + f"/{chars('0123456789', 3)}.png",
                     f"your-{pick(words)}-key-here-{chars('0123456789', 3)}", chars("0", 12) + chars("1234567890", 8) + "abcd",
                     "".join(pick(words).title() for _ in range(3)) + f"V{chars('0123456789', 2)}", f"{pick(words)}-{chars('0123456789', 1)}.{chars('0123456789', 2)}.{pick(words)}.tar.gz")[k]
            cue = pick(("commit", "sha256", "md5", "checksum", "etag", "uuid", "id", "version", "revision", "integrity")) if k < 2 else \
                pick(("href", "src", "import", "file", "example", "see", "name", "class", "password", "token", "key"))
            glue = pick((" ", ": ", "=", '="', " "))
            if rng.random() < 0.2:
                value = pick(("changeme", "<password>", "required", "${DB_PASSWORD}", "your_password", "get_token()", "os.environ", "optional",
                              "********", "{{ secret }}", f"{pick(words)}{pick(words)}", f"{pick(words)}_{pick(words)}", f"{pick(words)}.{pick(words)}"))
                cue, glue = pick(("password", "token", "secret", "api_key", "key")), pick((": ", "=", '="', ' = "'))
            path = pick(tests + plain + code)
        quote = glue[-1] if glue[-1] in "\"'" else ""
        start = len(f"{lead} {cue}{glue}")
        rows.append((f"{lead} {cue}{glue}{value}{quote} {tail}", start, start + len(value), path, int(secret)))
    return rows


class Forest:
    """Random forest of binary trees, kept as arrays."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = np.where(x[inner, feature[at]] <= cut[at], left[at], right[at])
            total += value[node]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 10, least: int = 3, seed: int = 23) -> Forest:
    """Trees on bootstrap samples, each split over a random third of the features by Gini."""
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(n_trees if len(y) else 0):
        nodes: list[list] = []

        def split(rows: np.ndarray, level: int) -> int:
            here = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
            if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
                return here
            best = (1e-12, -1, 0.0)
            p = y[rows].mean()
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows, f][order], np.cumsum(y[rows][order])
                k = np.arange(1, len(rows))
                ok = (v[1:] != v[:-1]) & (k >= least) & (len(rows) - k >= least)
                if not ok.any():
                    continue
                a, b = t[:-1] / k, (t[-1] - t[:-1]) / (len(rows) - k)
                gain = p * (1 - p) - (k * a * (1 - a) + (len(rows) - k) * b * (1 - b)) / len(rows)
                j = int(np.argmax(np.where(ok, gain, -1)))
                if gain[j] > best[0]:
                    best = (float(gain[j]), int(f), float((v[j] + v[j + 1]) / 2))
            if best[1] >= 0:
                go = x[rows, best[1]] <= best[2]
                nodes[here][:2] = [best[1], best[2]]
                nodes[here][2] = split(rows[go], level + 1)
                nodes[here][3] = split(rows[~go], level + 1)
            return here

        split(rng.integers(0, len(y), len(y)), 0)
        a = list(zip(*nodes))
        trees.append((np.array(a[0], np.int64), np.array(a[1]), np.array(a[2], np.int64), np.array(a[3], np.int64), np.array(a[4])))
    return Forest(trees)


def train(findings: list[tuple[str, int, int, str, int]]) -> Forest:
    rows = [features(t[s:e], t[max(0, s - 60):s], t[e:e + 60], path) for t, s, e, path, _ in findings]
    return grow(np.array(rows, float).reshape(-1, len(FEATURES)), np.array([f[4] for f in findings], float))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return train(labelled_findings())


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of runs that could be credentials; a run ends at '=' with a value behind it."""
    glue = np.flatnonzero(data[:-1] == 61)
    glue = glue[_CHARS[data[glue + 1]] & (data[glue + 1] != 61) & ~np.isin(glue + 1, offsets)]
    cut = data.copy()
    cut[glue] = 32
    starts, ends, _ = B.spans(cut, offsets, _CHARS)
    long = ends - starts >= LEAST
    starts, ends = starts[long], ends[long]
    count = lambda flags: np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
    digit, letter = count(_DIGIT), count(_LETTER)
    mixed = (digit[ends] > digit[starts]) & (letter[ends] > letter[starts])
    return starts[mixed], ends[mixed]


def cued(raw: bytes, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, row) of values of any characters that are assigned to a name with a leak cue."""
    found = []
    for r, (first, last) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for m in _CUED.finditer(raw, first, last):
            s, e = m.span(m.lastindex)
            if m.lastindex == 4:
                while e > s and raw[e - 1] in b",;)]}>.":
                    e -= 1
            if e - s >= LEAST_CUED:
                found.append((s, e, r))
    return found


def _merged(raw: bytes, runs: list[tuple[int, int, int]], values: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Both in order, each span once; a run in or across an assigned value gives way to it, but not to a sentence or
    an address, which can hold a secret among other things."""
    known = set(values)
    runs, spans = [x for x in runs if x not in known], values
    values = [v for v in values if not re.search(rb"[\s&?]|://", raw[v[0]:v[1]])]
    if not values:
        return sorted(runs + spans)
    starts, ends = np.array([v[0] for v in values]), np.array([v[1] for v in values])
    s, e = np.array([x[0] for x in runs], np.int64), np.array([x[1] for x in runs], np.int64)
    at = np.searchsorted(ends, s, "right")
    inside = (at < len(ends)) & (starts[np.minimum(at, len(ends) - 1)] < e)
    return sorted([x for x, i in zip(runs, inside) if not i] + spans)


def secrets(docs: DataFrame, forest: Forest | None = None, path: str | None = "source", threshold: float = 0.5,
            everything: bool = False) -> DataFrame:
    """One row per finding: its place in code points, a hash of it, the forest's score and
    verdict; ``everything`` returns the candidates that the forest drops as well."""
    forest = forest or default_forest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in P.grouped(batches, 4 << 20):
            paths = b.column("path")
            for first, last, data, offsets in B.pieces(b.column("text")):
                starts, ends = candidates(data, offsets)
                raw, rows, x, kept, runs = data.tobytes(), np.searchsorted(offsets, starts, "right") - 1, [], [], []
                for s, e, r in zip(starts.tolist(), ends.tolist(), rows.tolist()):
                    while e > s and raw[e - 1] in _TRIM and raw[e - 1] != 61:
                        e -= 1
                    while e > s and raw[s] in _TRIM:
                        s += 1
                    if e - s >= LEAST:
                        runs.append((s, e, r))
                for s, e, r in _merged(raw, runs, cued(raw, offsets)):
                    before = raw[max(int(offsets[r]), s - 60):s].decode("utf-8", "ignore")
                    after = raw[e:min(int(offsets[r + 1]), e + 60)].decode("utf-8", "ignore")
                    x.append(features(raw[s:e].decode("utf-8", "replace"), before, after, paths[first + r].as_py() or ""))
                    kept.append((s, e, r))
                spans = np.array(kept, np.int64).reshape(-1, 3)
                score = forest.chance(np.array(x, float).reshape(-1, len(FEATURES)))
                pick = np.arange(len(score)) if everything else np.flatnonzero(score >= threshold)
                s, e, r = spans[pick].T
                point = np.concatenate([[0], np.cumsum(B.HEAD[data], dtype=np.int64)])
                begin = point[offsets[r]]
                yield batch(doc_id=b.column("doc_id").take(pa.array(r + first)), start=point[s] - begin, end=point[e] - begin,
                            secret_sha256=pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(s.tolist(), e.tolist())], pa.string()),
                            score=score[pick], is_secret=pa.array(score[pick] >= threshold))

    found = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), found.alias("path"))
    return scan(slim, work, "doc_id long, start long, end long, secret_sha256 string, score double, is_secret boolean")


@query("op1_secret_scan")
def op1(spark, sf_dir):
    return secrets(read(spark, sf_dir, "documents"), everything=True)
