"""Near-dedup of embeddings: int8 tile products with rigorous error bounds, full precision where they leave doubt.

Equal vectors are one class. Signs of random projections cut the classes into buckets, several times over, so that
pairs at the threshold share a bucket all but surely; a bucket of many classes is cut into blocks and compared tile by
tile. In a tile, unit vectors become int8 with a scale each, their products are exact whole numbers, and the rounding
error of each vector bounds how far the true cosine can be. Only pairs that may reach the threshold are computed
again, in double precision. A pair that shares several buckets counts in the first one only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, stored
from .components import components

THRESHOLD = 0.95
#: Classes that a bucket should hold, and at most in a block; bits of a key at least.
BUCKET, BLOCK = 2048, 2048
LEAST_BITS = 4
#: Chance that a pair right at the threshold shares no bucket.
MISS = 1e-5
SEED = 11


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits per key and number of tables for ``n`` classes, such that a pair at the threshold is missed with a chance of MISS whatever ``n``."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / BUCKET)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def units(vectors: list) -> np.ndarray:
    """Unit vectors in double precision, one row each, of equally long finite vectors other than zero."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding took from each."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - q * scale[:, None]
    return q, scale, np.sqrt((lost * lost).sum(1)) + 1e-12


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which pairs of quantised rows may have a cosine of ``threshold``.

    With u = a + e, v = b + f the cosine differs from a.b by e.v + a.f, at most |e| + (1 + |e|) |f|.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    # Sums of products of int8 stay below 2^24 up to 1040 dimensions, so single precision holds them exactly.
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    product *= sa[:, None]
    product *= sb[None, :]
    product += ea[:, None] + (1 + ea[:, None]) * eb[None, :]
    return product >= threshold - 1e-9


def _vectors(packed: list[bytes]) -> list[np.ndarray]:
    """The vectors of packed rows: a letter for the kind of number, then the numbers."""
    return [np.frombuffer(r, "<f4" if r[:1] == b"f" else "<f8", offset=1).astype(np.float64) for r in packed]


def _packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, packed): the vector's numbers as bytes (floats as floats, which loses nothing), null for one that links with nothing."""
    single = "float" in vectors.schema["embedding"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            packed = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = None
                if i is not None and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no minus zero
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                packed.append(None if x is None else b"f" + x.astype("<f4").tobytes() if single else b"d" + x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["vec_id", "packed"])

    return vectors.mapInArrow(work, "vec_id bigint, packed binary")


def _keyed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``classes`` with ``keys``, a bucket for each table; vectors of other lengths have other buckets."""

    def work(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column("packed").to_pylist()
            keys, short = np.zeros((len(raw), tables), np.int64), np.zeros((len(raw), tables), np.uint32)
            size = np.array([(len(r) - 1) // (4 if r[:1] == b"f" else 8) for r in raw])
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, int(d)]).normal(size=(int(d), tables * bits))
                unit = units(_vectors([raw[i] for i in own]))
                signs = (unit @ planes[d] > 0).reshape(len(own), tables, bits)
                codes = (signs << np.arange(bits)).sum(2).astype(np.uint64)
                short[own] = codes
                keys[own] = mix(mix(codes + np.uint64(int(d) << 40)) + np.arange(tables, dtype=np.uint64)[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "n", "packed")), pa.FixedSizeListArray.from_arrays(keys.reshape(-1), tables).cast(pa.list_(pa.int64())), pa.array([c.tobytes() for c in short], pa.binary())],
                ["id", "n", "packed", "keys", "codes"],
            )

    return classes.mapInArrow(work, "id bigint, n bigint, packed binary, keys array<bigint>, codes binary")


def _tile_links(ids, weights, blocks, raw, keys, table: int, i: int, j: int, threshold: float):
    """Links that this tile counts: (id, weight of its partners) and a spanning forest of pairs."""
    blocks = np.array(blocks)
    rows, cols = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    unit = units(_vectors(raw))
    q = quantised(unit)
    part = lambda own: tuple(x[own] for x in q)
    partners = np.zeros(len(ids), np.int64)
    top = list(range(len(ids)))
    pairs = []

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    weights, keys = np.array(weights, np.int64), np.frombuffer(b"".join(keys), np.uint32).reshape(len(ids), -1)
    step = 512
    for a in range(0, len(rows), step):
        for b in range(0, len(cols), step):
            if i == j and b < a:
                continue
            x, y = np.nonzero(possible(part(rows[a : a + step]), part(cols[b : b + step]), threshold))
            x, y = rows[a + x], cols[b + y]
            if i == j and a == b:
                x, y = x[x < y], y[x < y]
            good = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[good], y[good]
            first = ~(keys[x, :table] == keys[y, :table]).any(1)
            x, y = x[first], y[first]
            np.add.at(partners, x, weights[y])
            np.add.at(partners, y, weights[x])
            for s, t in zip(x.tolist(), y.tolist()):
                s, t = find(s), find(t)
                if s != t:
                    top[t] = s
                    pairs.append((ids[s], ids[t]))
    some = np.flatnonzero(partners)
    return [(ids[k], int(partners[k]), None) for k in some.tolist()] + [(s, 0, t) for s, t in pairs]


def _compared(tiles: DataFrame, threshold: float) -> DataFrame:
    def work(batches):
        tile, rows = None, []

        def settle():
            found = _tile_links(*zip(*rows), tile[0], tile[2], tile[3], threshold)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["a", "links", "b"])

        for batch in batches:
            for t, key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, key, i, j) != tile and rows:
                    yield settle()
                    rows = []
                tile = (t, key, i, j)
                rows.append(row)
        if rows:
            yield settle()

    partitions = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ["t", "key", "i", "j"]
    return tiles.select(*at, "id", "n", "block", "packed", "codes").repartition(partitions, *at).sortWithinPartitions(*at).mapInArrow(work, "a bigint, links bigint, b bigint")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, any others).

    Vectors that are null, empty or zero, hold null or non-finite components or have a null id link with nothing;
    vectors of different lengths do not link. Repeated rows are vectors of their own that link with each other, but
    one node. A row with a null id has a null component and is kept. Other columns, whatever their names, are not looked
    at. An empty table gives an empty one.
    """
    rows = stored(_packed(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")), "packed")
    classes = stored(rows.filter("packed IS NOT NULL").groupBy("packed").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    bits, tables = plan(classes.count(), threshold)
    keyed = stored(_keyed(classes.select("id", "n", "packed"), bits, tables), "keyed")
    placed = keyed.select("id", F.posexplode("keys").alias("t", "key"))
    counts = stored(placed.groupBy("t", "key").agg(F.count("*").alias("size")).filter("size > 1"), "counts")
    exploded = keyed.select("id", "n", "packed", "codes", F.posexplode("keys").alias("t", "key")).join(counts, ["t", "key"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id", "packed"), blocks).cast("int")
    # A block meets itself and each other block once.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    tiles = exploded.withColumns({"blocks": blocks, "block": block}).withColumn("tile", F.explode(others)).select("t", "key", "tile.i", "tile.j", "id", "n", "block", "packed", "codes")
    found = stored(_compared(tiles, threshold), "found")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("outer"))
    joined = components(found.filter("b IS NOT NULL").select("a", "b"))
    whole = stored(classes.join(links, "id", "left").join(joined, "id", "left").select("packed", (F.coalesce("outer", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "whole")
    out = rows.join(whole, "packed", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP5_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
