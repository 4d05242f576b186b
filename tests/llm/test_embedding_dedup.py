import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import embedding_dedup as E


def brute(rows, threshold=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[k] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links = {k: [] for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a].append(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(links[k]), c, i == c))
    return sorted(out, key=str)


def vectors(n=300, d=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, d))
    rows = [(i, (base[i % len(base)] * rng.uniform(0.1, 9) + rng.uniform(0, 0.6) * rng.normal(size=d)).tolist()) for i in range(n)]
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1]), (n + 3, None), (n + 4, [0.0] * d), (n + 5, [float("nan")] * d), (n + 6, [None] * d), (n + 7, []), (n + 8, [1.0]), (n + 9, [2.0]), (None, rows[0][1]), (n + 10, [1e300] * d), (n + 11, [1e-300] * d), (n + 12, [float("inf")] + [0.0] * (d - 1))]
    return rows


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    return sorted(map(tuple, E.near_duplicate_vectors(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = vectors()
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [2048, 7])
def test_buckets_and_blocks(spark, monkeypatch, block):
    """Several tables of small buckets, cut into small blocks: nothing lost here, nothing counted twice."""
    monkeypatch.setattr(E, "BUCKET", 40)
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors(seed=1)
    assert E.plan(300)[0] == E.LEAST_BITS and E.plan(40 * 64)[0] == 6
    assert got(spark, rows) == brute(rows)


def test_bounds_are_rigorous():
    rng = np.random.default_rng(2)
    u = E.units(list(rng.normal(size=(400, 5)) ** 3))
    q = E.quantised(u)
    cos = u @ u.T
    for t in (0.5, 0.9, 0.95, 0.99):
        maybe = E.possible(q, q, t)
        assert not (cos[~maybe] >= t).any()
        assert maybe.sum() < 1.3 * (cos >= t - 0.05).sum()


def test_repeats_other_columns_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>").withColumn("packed", F.lit(1)).withColumn("id", F.lit(2))
    assert sorted(map(tuple, E.near_duplicate_vectors(df).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert E.near_duplicate_vectors(df.limit(0)).count() == 0


def test_floats_and_doubles_agree(spark):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors(120, seed=3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    both = [sorted(map(tuple, E.near_duplicate_vectors(d).collect()), key=str) for d in (df, df.withColumn("embedding", F.col("embedding").cast("array<float>")))]
    assert both[0] == both[1] == brute(rows)
