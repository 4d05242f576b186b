import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=50, positives=5, negatives=3):
    good = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * x) for x in v]
        if any(abs(x) >= 2**31 / max(len(ints), 1) ** 0.5 for x in ints):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        good[i] = min(good.get(i, (label, ints)), (label, ints))
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, (other, w) in good.items() if b != a and len(w) == len(v))
        for ps, p, _ in [r for r in scored if r[2] == label][:positives]:
            found = [r for r in scored if r[2] != label and 50 * -ps <= 100 * -r[0] <= 95 * -ps][:negatives]
            out += [(a, p, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(found)]
    return sorted(out)


def odd_rows():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(8, 12))
    rows = []
    for i in range(600):
        kind = i % 23
        v = (middle[i % 8] + 0.3 * rng.normal(size=12)).tolist()
        if kind == 0:
            v[3] = [None, math.nan, math.inf, -math.inf][i % 4]
        v = None if kind == 1 else [] if kind == 2 else v[:5] if kind in (3, 4) else [0.0] * 12 if kind == 5 else rows[i - 1][2] if kind in (6, 7) else v
        rows.append((i, None if kind == 8 else int(rng.integers(-2, 10)), v))
    rows += [(None, 1, [1.0] * 12), (50, 3, [0.5] * 12), (50, 2, [0.7] * 12), (650, 1, [1e300] * 12), (700, 1, [3e4] * 12), (701, 1, [3e4] * 12), (702, 2, [2e4] * 12)] + rows[100:140]
    return rows


@pytest.mark.parametrize("leaf_rows", [20, 4096])
def test_equals_comparing_all(spark, leaf_rows):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "leaf", "size", "rank", "score", "target")})
    want = brute(rows)
    assert len(want) > 60 and len({r[0] for r in want}) > 6
    assert sorted(tuple(r) for r in H.hard_negatives(frame, leaf_rows=leaf_rows).collect()) == want


def test_equal_rows_and_blocks_of_one_leaf(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    rows = [(i, i % 3, [1.0, 2.0] if i < 150 else [1.0, 1.0 + (i % 5) / 8]) for i in range(250)]
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), leaf_rows=40)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows) != []


def test_empty_tables_and_no_anchor(spark):
    frame = spark.createDataFrame([(7, 1, [1.0]), (8, 1, [1.0])], SCHEMA)
    assert H.hard_negatives(frame).count() == 0 == H.hard_negatives(frame.limit(0)).count()
    assert H.hard_negatives(frame).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_ranges_rule_out_far_clusters():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 32)) * 400
    x = np.floor(middle[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 32)) * 20).astype(np.int64)
    tree = H.Tree(x[:3000], 100)
    ranges = {}

    def note(node, d, child, own):
        length = np.sqrt((x[own].astype(float) ** 2).sum(1))
        for j in np.unique(child):
            for i, c in enumerate(np.c_[length[child == j], d[child == j]].T):
                a, b = ranges.get((node, j, i - 1), (np.inf, -np.inf))
                ranges[node, j, i - 1] = min(a, c.min()), max(b, c.max())

    leaf = tree.descend(x, note)
    tree.fill([(*k, *v) for k, v in ranges.items()])
    q = x[::80]
    product = q @ x.T
    least, most = np.sort(product, 1)[:, -30], product.max(1)
    seen = np.zeros((len(q), tree.leaves), bool)
    for at, own in tree.search(q, least, most):
        seen[own, at] = True
    needed = np.zeros_like(seen)
    for k in range(len(q)):
        needed[k, leaf[(product[k] >= least[k]) & (product[k] <= most[k])]] = True
    assert (seen | ~needed).all()
    sizes = np.bincount(leaf, minlength=tree.leaves)
    assert (seen @ sizes).mean() < 0.25 * len(x)
