import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import near_dedup as N
from earshot.llm.components import components


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i] = s
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                top[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=0):
    rng = random.Random(seed)
    v = [f"w{k}" for k in range(400)]
    rows = []

    def add(words):
        rows.append((len(rows) * 13 % 1009, " ".join(words)))

    for _ in range(25):
        base = [rng.choice(v) for _ in range(rng.choice([3, 5, 6, 7, 9, 40, 150]))]
        add(base)
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(v)
            add([x.upper() if rng.random() < 0.2 else x for x in w] + rng.choice([[], ["more"]]))
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, rows[0][1]), (2004, "one"), (2005, "ONE"), (2006, "é É"), (2007, "É é")]


@pytest.mark.parametrize("block", [1_000_000, 3000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus(block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: tuple(r)[1:] for r in N.near_duplicates(df).collect()} == brute(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """One family whose members link through few others, in blocks of about five."""
    monkeypatch.setattr(N, "BLOCK", 7000)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: tuple(r)[1:] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_repeated_ids_nulls_and_other_columns(spark):
    t = " ".join(f"w{k}" for k in range(30))
    u = " ".join(f"u{k}" for k in range(30))
    rows = [(5, t, 1), (5, t, 2), (3, t, 3), (None, t, 4), (7, u, 5), (3, u, 6), (9, "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class int").withColumn("n", F.lit(0)).withColumn("kept", F.lit("no"))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (7, 3, False), (3, 3, True), (9, 9, True)], key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        n = 2000
        both = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64)
        rest = n - len(both)
        a, b = (np.unique(np.r_[both, rng.integers(0, 2**63, rest, dtype=np.uint64)]) << np.uint64(1) for _ in range(2))
        found = N.registers([a, b])
        assert N.estimates(found[0], found[1:])[0][0] == pytest.approx(share, abs=0.12)
    assert (N.filled(N.registers([np.array([5 << 60], np.uint64)])) > 0).all()
    assert N.registers([np.empty(0, np.uint64)]).sum() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 100), (7, 7), (None, 3), (200, 100)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 100: 50, 200: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
