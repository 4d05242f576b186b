import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from earshot.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = Q.op10_quality_classifier(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet").merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.remainder(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (Q.quality_scores(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(a.score, b.score)


def test_isotonic_by_hand():
    place, share = Q.isotonic(np.arange(5.0), np.array([0, 2, 1, 1, 3.0]), np.array([1, 2, 2, 1, 3.0]))
    assert share.tolist() == [0, 0.75, 1] and place.tolist() == [0, 1.5, 3.75]


def test_normal_equations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=len(Q.STATISTICS)).tolist(), float(i % 2), i % Q.FOLDS) for i in range(50)]
    df = spark.createDataFrame(rows, "statistics array<float>, good double, fold int")
    zero, one = np.zeros(len(Q.STATISTICS)), np.ones(len(Q.STATISTICS))
    a, b = (Q.normal_equations(df.repartition(n), zero, one) for n in (1, 6))
    z = Q.fourier(np.array([r[0] for r in rows], np.float32).astype(float))
    assert np.allclose(a, b) and np.allclose(a.sum(0)[:, :-1], z.T @ z)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 2), (None, "", 3), (2, "x " * 200_000, 4), (3, "A fine text.\nWith lines.", 5)], "doc_id long, text string, statistics int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.quality_scores(docs, none).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in Q.quality_scores(docs, odd).collect())
    assert Q.quality_scores(docs.limit(0), odd).count() == 0


def test_against_plain_numpy(spark):
    """Fit, folds, calibration and scores of the query once more, with one matrix in memory."""
    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = np.array([Q.statistics(t) for t in docs.text], np.float32).astype(float)
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1
    z = np.hstack([np.ones((len(x), 1)), np.cos(np.clip((x - mean) / spread, -8, 8) @ _turn()[0] + _turn()[1]) * np.sqrt(2 / Q.FOURIER)])
    used = labels[[zlib.crc32(str(i).encode()) % 4 != 2 for i in labels.doc_id]]
    row = pd.Series(range(len(docs)), index=docs.doc_id)[used.doc_id].to_numpy()
    fold = {r[0]: r[1] for r in spark.createDataFrame([(int(i),) for i in used.doc_id], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(Q.FOLDS))).collect()}
    fold, y, own = np.array([fold[i] for i in used.doc_id]), used.quality.to_numpy(float), z[row]

    def weights(a, b):
        # The penalty follows the rows; the constant is free.
        penalty = np.full(a.shape[1], Q.RIDGE * len(a) + 1e-9)
        penalty[0] = 1e-9
        return np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ b)

    raw = np.empty(len(y))
    for f in range(Q.FOLDS):
        raw[fold == f] = own[fold == f] @ weights(own[fold != f], y[fold != f])
    bins = np.floor(np.clip(raw, -0.5, 1.5) * Q.BINS)
    place, count = np.unique(bins, return_counts=True)
    share = np.array([y[bins == b].mean() for b in place])
    sums, n = np.r_[0, np.cumsum(share * count)], np.r_[0, np.cumsum(count)]
    # The isotonic fit by its formula: the largest, over starts, of the smallest mean from there on.
    fit = np.array([max(min((sums[j + 1] - sums[i]) / (n[j + 1] - n[i]) for j in range(k, len(place))) for i in range(k + 1)) for k in range(len(place))])
    level = np.round(fit, 12)
    points = [(np.average((place[level == v] + 0.5) / Q.BINS, weights=count[level == v]), v) for v in np.unique(level)]
    score = np.clip(np.interp(z @ weights(own, y), *zip(*points)), 0, 1)
    got = Q.op10_quality_classifier(spark, SF).toPandas().set_index("doc_id").score[docs.doc_id].to_numpy()
    assert np.allclose(got, score, atol=2e-3) and ((got >= Q.ACCEPT) == (score >= Q.ACCEPT)).all()


def _turn():
    rng = np.random.default_rng(Q.SEED)
    return rng.normal(0, 1 / Q.LENGTH_SCALE, (len(Q.STATISTICS), Q.FOURIER)), rng.uniform(0, 2 * np.pi, Q.FOURIER)
