"""Hard negatives by a multiway hyperplane tree (GNAT): siblings leave a search by the ranges of their distances.

The tree's split points come from a bounded sample; every row of the table goes down the tree to the nearest split
point of each node, and what it measures on the way widens the range that each split point keeps of its distances to
each sibling's subtree. A search goes down with its anchor's distances to the split points: where the window of
scores, seen as an annulus around the anchor, cannot meet a subtree's range, the subtree is left out. The leaves that
stay compare whole vectors, exactly. First the leaves nearest to an anchor give a bound for what its best rows must
score, then all leaves that may hold better ones are searched, so results are those of comparing all rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Rows that the tree's split points are drawn from, children of a node, sample rows of a leaf at least.
SAMPLE, FANOUT, LEAF_SAMPLE = 20_000, 16, 24
#: Rows that a leaf should hold; a leaf with more is searched in blocks of so many.
BLOCK = 4096
#: Anchors that a row of the searches' tables carries at most.
ANCHORS = 256
#: Positives of an anchor, negatives of a positive, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Components, times the root of the vector's length, whose products a long adds up surely.
LARGEST = 2.0**31
_NONE = np.iinfo(np.int64).min


def participants(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): whole components floor(256 * x) as packed ints, labels moved by one of ten where the id is divisible by 7.

    Rows with a null id, label or vector or with a null or non-finite component take no part, nor do rows whose score
    a long might not hold (a component of 2^31 / sqrt(length) or more). Of rows that share an id the one with the
    smallest label, then the smallest components counts.
    """
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), "embedding")

    def work(batches):
        for batch in batches:
            packed = []
            for v in batch.column(2):
                x = None if v.values.null_count else np.floor(256.0 * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                good = x is not None and bool((np.abs(x) < LARGEST / max(len(x), 1) ** 0.5).all())
                packed.append(x.astype(">i4").tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["vec_id", "label", "v"])

    made = rows.mapInArrow(work, "vec_id bigint, label bigint, v binary").filter("v IS NOT NULL")
    return made.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def matrix(packed: list[bytes]) -> np.ndarray:
    """Rows of packed components of one length."""
    return np.frombuffer(b"".join(packed), ">i4").astype(np.int64).reshape(len(packed), -1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows of ``a`` with all of ``b``; by floats where these hold them."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of rows to points, right to 1e-9 of themselves and of the vectors' lengths."""
    x, points = x.astype(np.float64), points.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """Split points of each node and the node or leaf below each of them; ranges and lengths are filled in from all rows."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.points: list[np.ndarray] = []
        self.below: list[list[int]] = []  # a node's number, or -1 - leaf
        self.leaves = 0
        self._grow(sample, max(LEAF_SAMPLE, len(sample) // max(leaves, 1)), np.random.default_rng(seed))

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample: np.ndarray, least: int, rng: np.random.Generator) -> int:
        distinct = np.unique(sample, axis=0) if len(sample) > least and sample.size else sample[:0]
        if len(distinct) < 2:
            return self._leaf()
        # Far points first, out of three times as many candidates.
        k = min(FANOUT, len(distinct), max(2, len(sample) // least))
        some = distinct[rng.permutation(len(distinct))[: 3 * k]]
        chosen, far = [0], distances(some, some[:1])[:, 0]
        while len(chosen) < k:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(some, some[chosen[-1:]])[:, 0])
        points = some[chosen]
        node = len(self.points)
        self.points.append(points)
        self.below.append([])
        nearest = distances(sample, points).argmin(1)
        below = []
        for j in range(k):
            part = sample[nearest == j]
            below.append(self._leaf() if len(part) <= least or len(part) == len(sample) else self._grow(part, least, rng))
        self.below[node] = below
        return node

    def descend(self, x: np.ndarray, note=None) -> np.ndarray:
        """The leaf of each row; ``note(node, distances, child)`` hears of every step."""
        leaf = np.zeros(len(x), np.int64)
        ways = [(0, np.arange(len(x)))] if self.points else []
        while ways:
            node, own = ways.pop()
            d = distances(x[own], self.points[node])
            child = d.argmin(1)
            if note:
                note(node, d, child, own)
            for j, below in enumerate(self.below[node]):
                part = own[child == j]
                if len(part):
                    if below < 0:
                        leaf[part] = -1 - below
                    else:
                        ways.append((below, part))
        return leaf

    def fill(self, found: list) -> None:
        """Take ranges (node, child, split point or -1, least, most): distances of a subtree to a split point, or its lengths."""
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        self.short = [np.full(len(p), np.inf) for p in self.points]
        self.long = [np.full(len(p), -np.inf) for p in self.points]
        for node, child, point, least, most in found:
            if point < 0:
                self.short[node][child], self.long[node][child] = least, most
            else:
                self.low[node][point, child], self.high[node][point, child] = least, most

    def search(self, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of ``x`` that must look into it): where a row may score from ``least`` to ``most`` with the row of ``x``."""
        if not self.points:
            return [(0, np.flatnonzero(least <= most))]
        out, ways = [], [(0, np.flatnonzero(least <= most))]
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        while ways:
            node, own = ways.pop()
            d, norm = distances(x[own], self.points[node]), length[own]
            for j, below in enumerate(self.below[node]):
                if self.short[node][j] > self.long[node][j]:
                    continue  # no row came here
                # Triangle inequalities give the nearest and the farthest a row of the subtree can be.
                near = np.maximum(np.maximum(self.low[node][:, j] - d, d - self.high[node][:, j]).max(1), 0)
                far = (d + self.high[node][:, j]).min(1)
                slack = 1e-6 * (1 + norm + self.long[node][j]) ** 2
                top = np.minimum((norm**2 + self.long[node][j] ** 2 - near**2) / 2, norm * self.long[node][j]) + slack
                bottom = np.maximum((norm**2 + self.short[node][j] ** 2 - far**2) / 2, -norm * self.long[node][j]) - slack
                part = own[(top >= least[own]) & (bottom <= most[own])]
                if len(part):
                    if below < 0:
                        out.append((-1 - below, part))
                    else:
                        ways.append((below, part))
        return out


def _forest(rows: DataFrame, leaf_rows: int) -> tuple[dict[int, Tree], DataFrame, dict]:
    """Trees by vector length, the rows with their leaf and block, and the number of blocks of each leaf."""
    spark = rows.sparkSession
    sizes = {r["size"]: r["n"] for r in rows.groupBy(F.octet_length("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    trees = {}
    for size, n in sizes.items():
        own = rows.filter(F.octet_length("v") == size)
        drawn = own if n <= SAMPLE else own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1.05e6 * SAMPLE / n) + 1)
        sample = sorted(bytes(r["v"]) for r in drawn.select("v").limit(2 * SAMPLE).collect())
        trees[size] = Tree(matrix(sample), -(-n // leaf_rows))
    shared = spark.sparkContext.broadcast(trees)

    def work(batches):
        ranges: dict[tuple, list] = {}
        for batch in batches:
            packed = batch.column("v").to_pylist()
            lengths = np.array([len(p) for p in packed])
            leaves = np.zeros(len(packed), np.int64)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                x = matrix([packed[k] for k in at])
                norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))

                def note(node, d, child, own):
                    for j in np.unique(child):
                        mine = child == j
                        for i, column in enumerate(np.c_[norm[own][mine], d[mine]].T):
                            key = int(size), node, int(j), i - 1
                            old = ranges.get(key, (np.inf, -np.inf))
                            ranges[key] = min(old[0], float(column.min())), max(old[1], float(column.max()))

                leaves[at] = shared.value[int(size)].descend(x, note)
            none = pa.nulls(batch.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths), pa.array(leaves), none, none], names)
        if ranges:
            keys = np.array(list(ranges), np.int64)
            values = np.array(list(ranges.values()))
            empty = pa.nulls(len(keys), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 1]), pa.array(keys[:, 2]), empty, pa.array(keys[:, 0]), pa.array(keys[:, 3]), pa.array(values[:, 0]), pa.array(values[:, 1])], names)

    names = ["vec_id", "label", "v", "size", "leaf", "least", "most"]
    placed = stored(rows.select("vec_id", "label", "v").mapInArrow(work, "vec_id bigint, label bigint, v binary, size bigint, leaf bigint, least double, most double"), "placed")
    # Rows of ranges carry node and child in the first two columns and the split point in the fifth.
    spans = placed.filter("v IS NULL").groupBy("size", F.col("vec_id").alias("node"), F.col("label").alias("child"), F.col("leaf").alias("point")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    found: dict[int, list] = {}
    for r in spans.collect():  # bounded by the trees, whatever the rows
        found.setdefault(r["size"], []).append(tuple(r)[1:])
    for size, tree in trees.items():
        tree.fill(found.get(size, []))
    leaves = placed.filter("v IS NOT NULL").select("vec_id", "label", "v", "size", "leaf")
    counts = leaves.groupBy("size", "leaf").agg(F.count("*").alias("n"))
    blocks = {(r["size"], r["leaf"]): -(-r["n"] // BLOCK) for r in counts.collect()}
    shared.unpersist()
    return trees, leaves, blocks


def _blocked(leaves: DataFrame, blocks: dict) -> DataFrame:
    """Rows with the block of their leaf; the table of blocks has a row for each leaf of the trees."""
    table = leaves.sparkSession.createDataFrame([(*k, n) for k, n in blocks.items()], "size bigint, leaf bigint, blocks int")
    return leaves.join(F.broadcast(table), ["size", "leaf"]).select("size", "leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "label", "v")


#: An anchor's search: its row and leaf, a number that tells the anchor's searches apart, and the least and most score.
SEARCH = ["vec_id", "label", "v", "leaf", "target", "least", "most"]


def _visits(searches: DataFrame, trees, blocks: dict, nearest: bool) -> DataFrame:
    """(size, leaf, block, load): packs of searches and the leaf blocks that they must look into.

    With ``nearest`` that is the leaf that holds the anchor itself, otherwise all leaves but that one that the window of
    scores may meet.
    """

    def work(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(a, ANCHORS)
                packed = part.column("v").to_pylist()
                ids, label, leaves, target, least, most = (part.column(c).to_numpy() for c in SEARCH if c != "v")
                lengths = np.array([len(p) for p in packed])
                found = []
                for size in np.unique(lengths):
                    at = np.flatnonzero(lengths == size)
                    x, tree = matrix([packed[k] for k in at]), trees.value[int(size)]
                    home = leaves[at]
                    if nearest:
                        where = [(leaf, np.flatnonzero((home == leaf) & (least[at] <= most[at]))) for leaf in np.unique(home)]
                    else:
                        where = [(leaf, own[home[own] != leaf]) for leaf, own in tree.search(x, least[at], most[at])]
                    for leaf, own in where:
                        if len(own):
                            rows = at[own]
                            load = pickle.dumps((ids[rows], label[rows], x[own].astype(">i4"), target[rows], least[rows], most[rows]))
                            found += [(int(size), int(leaf), b, load, len(rows)) for b in range(blocks.get((int(size), int(leaf)), 0))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))], ["size", "leaf", "block", "load", "searches"])

    return searches.select(*SEARCH).mapInArrow(work, "size bigint, leaf bigint, block int, load binary, searches bigint")


def _looked_up(rows: DataFrame, visits: DataFrame, same: bool, top: int) -> DataFrame:
    """(anchor_id, target, vec_id, score): for each search the ``top`` rows of a block, of its label (``same``) or of others, within its window.

    A block's rows come first in their task and stay; the packs of searches pass by.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    a = rows.select("size", "leaf", "block", F.lit(0).alias("kind"), "vec_id", "label", "v")
    b = visits.select("size", "leaf", "block", F.lit(1).alias("kind"), nothing("bigint").alias("vec_id"), nothing("bigint").alias("label"), F.col("load").alias("v"))
    at = ["size", "leaf", "block"]

    def work(batches):
        now, held, block = None, [], None
        for batch in batches:
            for *key, kind, vec_id, label, v in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    now, held, block = key, [], None
                if kind == 0:
                    held.append((vec_id, label, v))
                elif held:
                    if block is None:
                        held.sort()  # so that the first of equal scores has the smallest id
                        block = np.array([r[0] for r in held]), np.array([r[1] for r in held]), matrix([r[2] for r in held])
                    yield from _best(block, pickle.loads(v), same, top)

    dealt = a.unionByName(b).repartition(*at).sortWithinPartitions(*at, "kind")
    return dealt.mapInArrow(work, "anchor_id bigint, target bigint, vec_id bigint, score bigint")


def _best(block: tuple, load: tuple, same: bool, top: int):
    ids, labels, x = block
    anchor, label, v, target, least, most = load
    product = scores(v.astype(np.int64), x)
    fits = (labels[None, :] == label[:, None]) == same
    fits &= (product >= least[:, None]) & (product <= most[:, None]) & (ids[None, :] != anchor[:, None])
    product[~fits] = _NONE
    out = []
    for k in range(len(anchor)):
        row = product[k]
        some = np.flatnonzero(row != _NONE)
        if len(some) > top:
            edge = np.partition(row[some], len(some) - top)[len(some) - top]
            some = some[row[some] >= edge]
        some = some[np.lexsort((ids[some], -row[some]))][:top]
        out += [(int(anchor[k]), int(target[k]), int(ids[j]), int(row[j])) for j in some]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["anchor_id", "target", "vec_id", "score"])


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best of each search, with their rank."""
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY anchor_id, target ORDER BY score DESC, vec_id) AS rank")
    return ranked.filter(F.col("rank") <= top)


def _searched(rows: DataFrame, searches: DataFrame, trees, blocks: dict, same: bool, top: int) -> DataFrame:
    """(anchor_id, target, vec_id, score, rank): the ``top`` best of each search, exactly.

    The nearest leaf comes first; where it already holds ``top`` rows, what others must reach is the last one's score.
    """
    first = stored(_looked_up(rows, _visits(searches, trees, blocks, True), same, top), "nearest")
    bound = _ranked(first, top).filter(F.col("rank") == top).select(F.col("anchor_id").alias("vec_id"), "target", F.col("score").alias("bound"))
    narrowed = searches.join(bound, ["vec_id", "target"], "left").withColumn("least", F.greatest("least", F.coalesce("bound", "least"))).drop("bound")
    rest = _looked_up(rows, _visits(narrowed, trees, blocks, False), same, top)
    return stored(_ranked(first.unionByName(rest), top), "best")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, leaf_rows: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of ``vectors`` (vec_id, label, embedding, any others).

    Anchors are the rows whose vec_id is divisible by ``every``; positives the best ``positives`` other rows of their
    label; negatives the best ``negatives`` rows of other labels that score from half to 0.95 times the positive.
    Equal scores go by the smaller vec_id. Rows that take no part: see ``participants``; rows of other lengths than the
    anchor's are not compared with it. An anchor without partners gives no row; an empty table gives an empty one.
    """
    rows = stored(participants(vectors), "participants")
    trees, leaves, blocks = _forest(rows, leaf_rows)
    placed = stored(_blocked(leaves, blocks), "leaves")
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    # Near anchors share packs, so that packs look into few leaves.
    anchors = placed.filter(F.pmod("vec_id", F.lit(every)) == 0)
    limits = [F.lit(-(2**62)).alias("least"), F.lit(2**62).alias("most")]
    asked = stored(anchors.repartition("size", "leaf", "block").sortWithinPartitions("size", "leaf").select("vec_id", "label", "v", "leaf", F.lit(0).cast("bigint").alias("target"), *limits), "anchors")
    best = _searched(placed, asked, shared, blocks, True, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The window's ends as whole numbers, rounded inwards; below zero there is no window.
    low, high = (F.expr(f"(CAST(positive_score AS DECIMAL(20, 0)) * {by} + {up}) div 100") for by, up in ((LOW, 99), (HIGH, 0)))
    windows = best.filter("positive_score >= 0").select(F.col("anchor_id").alias("vec_id"), F.col("positive_id").alias("target"), low.alias("least"), high.alias("most"))
    windows = stored(asked.select("vec_id", "label", "v", "leaf").join(windows, "vec_id"), "windows")
    found = _searched(placed, windows, shared, blocks, False, negatives)
    named = found.select("anchor_id", F.col("target").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(best, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


OP12_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
