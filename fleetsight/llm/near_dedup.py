"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Texts with equal shingle sets are one class, whose smallest document stands for it.  Each tree has
its own order of the MinHash values, and a class's label in it is its values in that order.  The rows
of a tree are dealt by ranges of labels and sorted; rows whose labels begin alike are a region, and
lie together.  A region is as deep as it has to be: it is searched where ``LEVELS[0]`` common values
leave it small, label neighbours (the longest common beginnings) first and then the parts that these
leave, as a spanning forest: never all pairs.  Regions are counted in Spark.  Rows of a crowded one
meet its most typical row, and where that leaves rows over, all rows of the region go on along their
labels to the next of ``LEVELS``, in as many more trees as a longer common beginning needs.  Regions
that are crowded at full depth are compared whole, what the typical row leaves over with all rows, in
tiles of bounded size.

Candidate components then get their full sets, once each.  Sets of a component are compared
exactly, by breadth first search over true links, so that links inside a connected part are never
listed.  A component of over ``CELL`` classes is compared with its most linked class first; only what
that leaves over meets the component's other classes, in blocks of bounded size.  True links make
the final components.

Chances: two sets of similarity 0.8 share a region with probability 0.99999 at each level that they
get to, and their sketches agree enough (36 of 64 values) with probability 0.99999; together at least
0.99996 through all levels, and more similar sets more surely.

Defined cases: null and empty texts have no shingles and are alone; a text of one word has one
shingle; a null ``doc_id`` has a null component and is kept; rows that share a ``doc_id`` count as
one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm import bytetext as B
from fleetsight.llm import packed as P
from fleetsight.llm.components import components
from fleetsight.llm.frames import batch, query, read, scan, texts
from fleetsight.session import materialize

VALUES, TREES = 128, 16
LEVELS = (3, 5, 8)
DEPTH = VALUES // TREES
LABEL = 1 + 2 * DEPTH
SKETCH = 64
SAMPLE = 256
REGION = 4096
CELL = 1024
_A = np.random.default_rng(20).integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts (sorted within a text), and where each text's begin."""
    low = B.LOWER[data]
    starts, ends, at = B.spans(low, offsets, B.WORD)
    h = B.hashes(low, starts, ends)
    pairs = B.rolled(h, size)
    parts = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            parts.append(np.unique(pairs[a:b - size + 1]))
        elif b > a:
            whole = h[a]
            for x in h[a + 1:b]:
                whole = B.mixed(np.array([whole])) [0] + x
            parts.append(B.mixed(np.array([whole ^ np.uint64(b - a)])))
        else:
            parts.append(pairs[:0])
    return (np.concatenate(parts) if parts else pairs[:0],
            np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, signature) of every text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                sets, at = shingle_sets(data, offsets, size)
                n = np.diff(at)
                filled = np.flatnonzero(n)
                sig = np.zeros((last - first, len(_A)), np.uint16)
                if len(filled):
                    for j, a in enumerate(_A):
                        least = np.minimum.reduceat(sets * a, at[:-1][filled])
                        sig[filled, j] = B.mixed(least) >> np.uint64(48)
                keys = np.array([np.frombuffer(hashlib.blake2b(sets[s:e].tobytes(), digest_size=16).digest(), np.int64)
                                 for s, e in zip(at[:-1], at[1:])], np.int64).reshape(-1, 2)
                yield batch(doc_id=b.column("doc_id").slice(first, last - first), n_shingles=n, h1=keys[:, 0], h2=keys[:, 1],
                            signature=pa.array([s.tobytes() for s in sig], pa.binary()))

    return scan(docs, work, "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def trees_needed(depth: int, similar: float = 0.8, miss: float = 1e-5) -> int:
    """Trees over ``depth`` of the ``VALUES`` values each, so that a pair of this similarity misses all of
    them with no more than this probability.  Trees share values, so the number that agrees is summed over."""
    agree = np.array([comb(VALUES, m) * similar**m * (1 - similar)**(VALUES - m) for m in range(VALUES + 1)])
    apart = 1 - np.array([comb(m, depth) / comb(VALUES, depth) for m in range(VALUES + 1)])
    trees = 1
    while agree @ apart**trees > miss:
        trees += 1
    return trees


def sketch_agreement(similar: float, miss: float = 1e-5) -> int:
    """The most equal values of a sketch to ask for, so that a pair of this similarity has fewer with no
    more than this probability.  One test serves all trees, as the sketch is the same in all."""
    below = 0.0
    for n in range(SKETCH + 1):
        below += comb(SKETCH, n) * similar**n * (1 - similar)**(SKETCH - n)
        if below > miss:
            return n
    return SKETCH


@lru_cache(maxsize=1)
def orders() -> np.ndarray:
    """The signature values that make the label of a row in each tree, in their order; those of the first
    ``TREES`` share none."""
    rng = np.random.default_rng(31)
    more = [rng.choice(VALUES, DEPTH, replace=False) for _ in range(trees_needed(DEPTH) - TREES)]
    return np.concatenate([np.arange(VALUES).reshape(TREES, DEPTH), more])


def tree_columns(level: int) -> list[np.ndarray]:
    """The beginnings of the labels that a region of this level shares, one for each tree in use."""
    trees = TREES if level == 0 else trees_needed(LEVELS[level])
    return [order[:LEVELS[level]] for order in orders()[:trees]]


def _prefix(level: int) -> int:
    """Bytes of a label that the rows of a region share: the tree's number and ``LEVELS[level]`` values."""
    return 1 + 2 * LEVELS[level]


def _tree_rows(level: int, with_sketch: bool = True):
    """One row per class and tree: label, region (its beginning), class, sketch; or the regions alone.
    Values are written with the high byte first, so that labels sort as their values do."""
    trees = len(tree_columns(level))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)
            sketch = np.ascontiguousarray((sig[:, ::VALUES // SKETCH] & 0xFF).astype(np.uint8))
            sketches = _binary(sketch) if with_sketch else None
            for t, order in enumerate(orders()[:trees]):
                label = np.full((len(sig), LABEL), t, np.uint8)
                label[:, 1:] = np.ascontiguousarray(sig[:, order], ">u2").view(np.uint8)
                region = _binary(label[:, :_prefix(level)])
                yield batch(region=region, label=_binary(label), node=b.column("node"), sketch=sketches) if with_sketch \
                    else batch(region=region)

    return work


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a column."""
    n, width = rows.shape
    offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


class Forest:
    """Links between rows, kept only where they join two parts."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _search(rows: np.ndarray, sketch: np.ndarray, enough: int, forest: Forest) -> None:
    """Breadth first over a region: each row found meets only the rows not found yet."""
    left = rows
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = (sketch[left] == sketch[i]).sum(1) >= enough
            for j in left[near].tolist():
                forest.add(i, j)
                queue.append(j)
            left = left[~near]


def _numbered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by label, with the number of their region: a run of labels that agree in ``width`` bytes."""
    last, n = None, 0
    for b in batches:
        if b.num_rows:
            labels = _bytes(b.column("label"), LABEL)[:, :width]
            new = np.ones(len(labels), np.int64)
            new[1:] = (labels[1:] != labels[:-1]).any(1)
            new[0] = last is None or (labels[0] != last).any()
            number = n + np.cumsum(new)
            last, n = labels[-1], int(number[-1])
            yield batch(region=number, node=b.column("node"), sketch=b.column("sketch"))


def _candidates(enough: int, width: int = 0):
    """Candidates of regions (or tiles) of bounded size.  In a region, the neighbours in the order of the labels,
    which have the longest common beginnings, meet first; then the parts that these leave."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in P.complete_runs(_numbered(batches, width) if width else batches, "region"):
            region, node = np.asarray(b.column("region")), np.asarray(b.column("node"))
            sketch = _bytes(b.column("sketch"), SKETCH)
            forest = Forest()
            ends = np.append(np.flatnonzero(region[1:] != region[:-1]) + 1, len(region))
            size = np.diff(np.concatenate([[0], ends]))
            small = np.repeat(size <= 16, size)
            stop = np.repeat(ends, size)
            for step in range(1, 16):
                i = np.flatnonzero(small & (np.arange(len(region)) + step < stop))
                if not len(i):
                    break
                near = (sketch[i] == sketch[i + step]).sum(1) >= enough
                for a in i[near].tolist():
                    forest.add(a, a + step)
            for s, e in zip((ends - size)[size > 16].tolist(), ends[size > 16].tolist()):
                _search(np.arange(s, e), sketch, enough, forest)
            links = np.array(forest.links, np.int64).reshape(-1, 2)
            yield batch(a=node[links[:, 0]], b=node[links[:, 1]])

    return work


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A column of values of this many bytes as rows of an array."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(-1, width)


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most typical row of a sample of each region."""
    for b in P.complete_runs(batches, "region"):
        sketch, found = _bytes(b.column("sketch"), SKETCH), []
        for s, e in P.runs(np.asarray(b.column("region"))):
            typical = np.array([np.bincount(c, minlength=256).argmax() for c in sketch[s:e].T], np.uint8)
            found.append(s + int((sketch[s:e] == typical).sum(1).argmax()))
        at = pa.array(found, pa.int64())
        yield batch(region=b.column("region").take(at), hub=b.column("node").take(at), hub_sketch=b.column("sketch").take(at))


def _beside_hub(enough: int):
    """Which rows are candidates of the hub beside them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_bytes(b.column("sketch"), SKETCH) == _bytes(b.column("hub_sketch"), SKETCH)).sum(1) >= enough
            yield batch(region=b.column("region"), node=b.column("node"), hub=b.column("hub"), near=pa.array(near))

    return work


def _salts(count: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))


def _in_tiles(hot: DataFrame, rest: DataFrame, enough: int, most: int) -> DataFrame:
    """Candidates between the rows of ``rest`` and all rows of their regions, in blocks."""
    half = max(1, most // 2)
    n_rest = rest.groupBy("region").agg(F.ceil(F.count("*") / half).alias("parts"))
    rows = hot.join(n_rest, "region").withColumn("blocks", F.ceil(F.col("count") / half))
    left = (rows.join(rest.select("region", "node"), ["region", "node"], "left_semi")
            .withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))).withColumn("block", _salts("blocks")))
    right = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("part", _salts("parts"))
    tile = F.xxhash64("region", "part", "block").alias("region")
    tiles = left.select(tile, "node", "sketch").unionByName(right.select(tile, "node", "sketch"))
    return scan(tiles.repartition("region").sortWithinPartitions("region", "node"), _candidates(enough), "a long, b long").where("a != b")


def candidate_links(nodes: DataFrame, enough: int, most: int) -> DataFrame:
    """(a, b): a spanning forest of the candidates among classes (node, signature)."""
    found = None
    for level in range(len(LEVELS)):
        rows = scan(nodes, _tree_rows(level), "region binary, label binary, node long, sketch binary")
        crowded = materialize(scan(nodes, _tree_rows(level, False), "region binary").groupBy("region").count()
                              .where(F.col("count") > most), "crowded_regions")
        calm = crowded.isEmpty()
        fit = rows if calm else rows.join(crowded, "region", "left_anti")
        in_order = fit.repartitionByRange("region").select("label", "node", "sketch").sortWithinPartitions("label", "node")
        links = materialize(scan(in_order, _candidates(enough, _prefix(level)), "a long, b long"), "candidates")
        found = links if found is None else found.unionByName(links)
        if calm:
            break
        crowded = crowded.select(F.col("region").alias("prefix"), F.xxhash64("region").alias("region"), "count")
        hot = materialize(rows.withColumnRenamed("region", "prefix").join(crowded, "prefix")
                          .select("region", "node", "sketch", "count"), "hot_rows")
        some = hot.where(F.pmod(F.xxhash64("node", "region"), F.ceil(F.col("count") / SAMPLE)) == 0)
        hubs = scan(some.select("region", "node", "sketch").repartition("region").sortWithinPartitions("region", "node"), _hubs,
                    "region long, hub long, hub_sketch binary")
        blocks = F.ceil(F.col("count") / most)
        spread = hubs.join(crowded.select("region", "count"), "region").withColumn("blocks", blocks).withColumn("salt", _salts("blocks"))
        beside = (hot.withColumn("salt", F.pmod(F.xxhash64("node"), blocks)).select("region", "salt", "node", "sketch")
                  .join(spread.select("region", "salt", "hub", "hub_sketch"), ["region", "salt"]))
        judged = materialize(scan(beside.select("region", "node", "sketch", "hub", "hub_sketch"), _beside_hub(enough),
                                  "region long, node long, hub long, near boolean"), "beside_hubs")
        found = found.unionByName(judged.where("near and node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        rest = judged.where("not near").select("region", "node")
        if rest.isEmpty():
            break
        if level == len(LEVELS) - 1:
            found = found.unionByName(materialize(_in_tiles(hot, rest, enough, most), "tiled"))
        else:
            going = hot.join(rest.select("region").distinct(), "region", "left_semi").select("node").distinct()
            nodes = materialize(nodes.join(going, "node", "left_semi"), "going_on")
    return found


def _linked(inter: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def true_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between these sets, exactly."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        inter = np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
        return [(0, 1)] if _linked(inter, int(size[0]), size[1:], percent)[0] else []
    flat = np.concatenate(sets)
    values, code = np.unique(flat, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(values), bool)
    left, links = np.arange(len(sets)), []
    element, owner = code, np.repeat(np.arange(len(sets)), size)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        keep = owner != queue[0]
        element, owner = element[keep], owner[keep]
        while queue and len(left):
            i = queue.pop()
            mine = code[at[i]:at[i + 1]]
            mark[mine] = True
            inter = np.bincount(owner[mark[element]], minlength=len(sets))[left]
            mark[mine] = False
            near = _linked(inter, int(size[i]), size[left], percent)
            if near.any():
                for j in left[near].tolist():
                    links.append((i, j))
                    queue.append(j)
                gone = np.zeros(len(sets), bool)
                gone[left[near]] = True
                keep = ~gone[owner]
                element, owner = element[keep], owner[keep]
                left = left[~near]
    return links


def _cells(percent: int):
    """True links of each cell of sets."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in P.complete_runs(batches, "cell"):
            cell, node = np.asarray(b.column("cell")), np.asarray(b.column("node"))
            bodies, found = b.column("shingles"), []
            for s, e in P.runs(cell):
                if e - s > 1:
                    sets = [np.frombuffer(bodies[i].as_py(), np.uint64) for i in range(s, e)]
                    found += [(s + i, s + j) for i, j in true_links(sets, percent)]
            links = np.array(found, np.int64).reshape(-1, 2)
            yield batch(a=node[links[:, 0]], b=node[links[:, 1]])

    return work


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in B.pieces(b.column("text")):
                sets, at = shingle_sets(data, offsets, size)
                yield batch(cell=b.column("cell").slice(first, last - first), node=b.column("node").slice(first, last - first),
                            shingles=pa.array([sets[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary()))

    return work


def _with_hub(percent: int):
    """Which sets link to the hub's set beside them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, last, hub = [], None, None
            for mine, other in zip(b.column("shingles"), b.column("hub_set")):
                other = other.as_py()
                if other != last:
                    last, hub = other, np.frombuffer(other, np.uint64)
                own = np.frombuffer(mine.as_py(), np.uint64)
                inter = np.array([len(np.intersect1d(own, hub, assume_unique=True))])
                near.append(bool(_linked(inter, len(own), np.array([len(hub)]), percent)[0]))
            yield batch(cell=b.column("cell"), node=b.column("node"), hub=b.column("hub"), near=pa.array(near))

    return work


def _crowded_links(sets: DataFrame, links: DataFrame, sizes: DataFrame, percent: int, cell: int) -> DataFrame:
    """True links of components of over ``cell`` classes: hub first, then what is left in blocks."""
    sets = materialize(sets, "crowded")
    degree = (links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
              .groupBy("node").count())
    hubs = (sets.select("cell", "node").distinct().join(degree, "node")
            .groupBy("cell").agg(F.max_by("node", F.struct("count", -F.col("node"))).alias("hub")))
    hub_sets = (sets.join(hubs.withColumnRenamed("hub", "node"), ["cell", "node"])
                .select("cell", F.col("node").alias("hub"), F.col("shingles").alias("hub_set")).dropDuplicates(["cell"]))
    blocks = sizes.select("cell", F.ceil(F.col("size") / (cell // 2)).cast("int").alias("blocks"))
    salted = sets.join(blocks, "cell").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = hub_sets.join(blocks, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    judged = materialize(scan(salted.join(spread.drop("blocks"), ["cell", "salt"]).select("cell", "node", "hub", "shingles", "hub_set"),
                              _with_hub(percent), "cell long, node long, hub long, near boolean"), "hubs")
    rest = judged.where("not near").groupBy("cell", "node").agg(F.first("hub").alias("hub"))
    n_rest = rest.groupBy("cell").agg(F.ceil(F.count("*") / (cell // 2)).cast("int").alias("parts"))
    left = (sets.join(rest.select("cell", "node"), ["cell", "node"], "left_semi").join(blocks, "cell").join(n_rest, "cell")
            .withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))))
    right = (sets.join(blocks, "cell").join(n_rest, "cell")
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))))
    tile = F.xxhash64("cell", "part", "block").alias("cell")
    tiles = left.select(tile, "node", "shingles").unionByName(right.select(tile, "node", "shingles")).dropDuplicates(["cell", "node"])
    found = scan(tiles.repartition("cell").sortWithinPartitions("cell"), _cells(percent), "a long, b long")
    return judged.where("near and node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(found)


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, cell: int = CELL,
                    region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    docs = texts(docs)
    slim = materialize(signatures(docs, size), "signatures")
    full = slim.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "signature")).alias("m"), F.count("*").alias("copies"))
    nodes = classes.select(F.col("m.doc_id").alias("node"), F.col("m.signature").alias("signature"))
    links = candidate_links(nodes, sketch_agreement(percent / 100), region)
    members = materialize(components(links), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).select(F.col("component").alias("cell"), "size")
    wanted = members.select(F.col("node"), F.col("component").alias("cell")).join(sizes, "cell")
    large = wanted.where(F.col("size") > cell)

    def full_sets(of: DataFrame) -> DataFrame:
        """Shingle sets of these classes; the join is a shuffle whatever their number."""
        met = docs.join(of.select("node", "cell").hint("shuffle_hash"), docs["doc_id"] == F.col("node"))
        return scan(met.select("node", "cell", "text"), _sets(size), "cell long, node long, shingles binary")

    true = scan(full_sets(wanted.where(F.col("size") <= cell)).repartition("cell").sortWithinPartitions("cell"),
                _cells(percent), "a long, b long")
    if not large.isEmpty():
        true = true.unionByName(_crowded_links(full_sets(large), links, sizes.where(F.col("size") > cell), percent, cell))
    parts = components(true)
    named = (classes.select("h1", "h2", F.col("m.doc_id").alias("node"), "copies").join(parts, "node", "left")
             .where("copies > 1 or component is not null")
             .select("h1", "h2", F.coalesce("component", "node").alias("component")))
    out = slim.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """The rows and columns of ``docs`` with one document of each component, that of the smallest
    ``doc_id``; documents without an id stay."""
    gone = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (
 SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(id, label) USING KEY (id) AS (SELECT doc_id, doc_id FROM documents UNION
 (SELECT DISTINCT ON (p.id) p.id, q.label FROM recurring.cc AS p, l, cc AS q
  WHERE p.id = l.a AND l.b = q.id AND q.label < p.label ORDER BY p.id, q.label))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, label AS component_id, label = d.doc_id AS kept
FROM documents d JOIN cc ON cc.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("op5_near_dedup", SQL)
def op5(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))
