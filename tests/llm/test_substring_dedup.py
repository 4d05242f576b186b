import random
import re

import numpy as np
from pyspark.sql import functions as F

from earshot.llm import substring_dedup as S


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        w = words[i]
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone |= set(range(k, k + window))
            seen.add(key)
        out[rows[i][0]] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def got(df, **kw):
    return {r["doc_id"]: tuple(r)[1:] for r in S.dedup_substrings(df, **kw).collect()}


def test_against_brute_force(spark):
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "x\x85y", " "]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            a = rng.randint(0, 30)
            w[10:10] = passage[a : a + 30]
        rows.append((i * 7 % 60, rng.choice(["\n", " ", "\t "]).join(w)))
    rows += [(60, None), (61, ""), (62, "The " * 50), (63, rows[0][1]), (64, " ".join(f"u{k}" for k in range(30_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 20)
    for parts in (1, 5):
        assert got(df.repartition(parts)) == want
    assert got(df, buckets=1) == want
    assert got(df, window=6) == brute(rows, 6)


def test_small_chunks_meet_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 300)
    monkeypatch.setattr(S, "SETTLED", 500)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(80))) for i in range(30)]
    chunks = list(S._chunks(iter([spark.createDataFrame([(i, i, t) for i, t in rows], "i long, p long, t string").toArrow().to_batches()[0]])))
    assert len(chunks) > 1
    df = spark.createDataFrame([*rows, *rows[:9]], "doc_id long, text string").repartition(16)
    assert got(df, window=5) == brute(rows, 5)
    # One bucket for all, settled again and again as passages come in.
    assert got(df, window=5, buckets=1) == brute(rows, 5)


def test_equal_hashes_are_settled_by_words():
    texts = [b"a b c d e f", b"g h i j k l", b"a b c d e f"]
    p = S.Passages([0, 1, 2], [5, 6, 7], [0, 0, 0], texts, 4)
    p.keys = np.zeros(len(p.keys), np.uint64)
    assert p.repeated().tolist() == [False] * 6 + [True] * 3


def test_repeated_rows_nulls_and_other_columns(spark):
    t = " ".join(f"w{k}" for k in range(25))
    rows = [(1, t, "x"), (1, t, "y"), (None, t, "z"), (2, t, None), (1, "other " + t, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").withColumn("id", F.lit(1)).withColumn("print", F.lit(2))
    out = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_removed"]) for r in S.dedup_substrings(df).collect())
    # The null id comes first and keeps its words; equal rows share a result; one word of the longer text is new.
    assert out == [(-1, 0), (1, 25), (1, 25), (1, 25), (2, 25)]
    assert S.dedup_substrings(df.limit(0)).count() == 0
