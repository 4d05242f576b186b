import numpy as np
import pytest

from earshot.jobs.reports import activity_report, embedding_report, enhancement_report
from earshot.operators import embeddings, scores


def pairs(spark, rows):
    return spark.createDataFrame([(k, *([float(v) for v in a] for a in rest)) for k, *rest in rows], "key string, enh array<double>, clean array<double>, noisy array<double>")


def by_hand(x, y):
    x, y = x - x.mean(), y - y.mean()
    t = (x @ y) / (y @ y + 1e-8) * y
    return 10 * np.log10((t @ t) / ((x - t) @ (x - t) + 1e-8) + 1e-8)


def test_si_snr_directly(spark):
    rng = np.random.default_rng(0)
    c = rng.normal(size=200)
    e, n = c + 0.1 * rng.normal(size=200), np.r_[c + rng.normal(size=200), 5.0]
    got = scores.with_improvement(pairs(spark, [("a", e, c, n), ("s", np.zeros(9), c, n)])).orderBy("key").collect()
    top = lambda w: w / np.abs(w).max()
    assert got[0]["sisnr"] == pytest.approx(by_hand(top(e), top(c)), abs=1e-4)
    assert got[0]["sisnri"] == pytest.approx(by_hand(top(e), top(c)) - by_hand(top(n[:200]), top(c)), abs=1e-4)
    assert (got[0]["nsr"], got[0]["unscored"], got[1]["sisnr"], got[1]["unscored"]) == (0, False, None, True)


def test_family_directly(spark):
    rng = np.random.default_rng(1)
    y, x = rng.normal(size=(2, 64))
    df = pairs(spark, [("a", x, y, y)])
    x0, y0 = x - x.mean(), y - y.mean()
    a = (x0 @ y0) / (y0 @ y0)
    want = {"sdr": (y0, x0 - y0, 0), "sdsdr": (a * y0, x0 - y0, 0), "sisnr": (a * y0, x0 - a * y0, 0), "tsdr": (y0, x0 - y0, 1e-3)}
    for kind, (t, e, tau) in want.items():
        assert scores.sdr_loss(df, kind).first()["loss"] == pytest.approx(-10 * np.log10((t @ t) / (e @ e + tau * (t @ t))), abs=1e-3)


def test_f1_by_hand(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("a", 0, 0), ("b", 0, 0)], "key string, label int, value int")
    got = {r["key"]: r for r in scores.confusion(rows).collect()}
    assert (got["a"]["accuracy"], got["a"]["tp"], got["a"]["fp"]) == (0.5, 1, 1)
    assert got["a"]["f1"] == pytest.approx(0.5, abs=1e-6) and got["b"]["f1"] == 1e-7


def test_epochs_by_hand(spark):
    log = spark.createDataFrame([(e, float(v)) for e, v in enumerate([3, 2, 2, 5, 4])], "epoch int, loss double")
    got = scores.epochs(log, 2).orderBy("epoch").collect()
    assert [r["best_epoch"] for r in got] == [0, 1, 2, 2, 2] and [r["stop"] for r in got] == [False, False, False, False, True]


def test_reports(spark):
    rng = np.random.default_rng(2)
    table = lambda m: spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(m)], "key string, w array<double>")
    c = rng.normal(size=(5, 50))
    rows, means = enhancement_report(table(c), table(c + 0.1), table(c + rng.normal(size=(5, 50))))
    assert rows.count() == 5 and means.first()["n"] == 5
    seq = spark.createDataFrame([("a", i, p, int(p > 0.5)) for i, p in enumerate([0.9, 0.9, 0.1, 0.9, 0.1])], "key string, pos long, p double, label int")
    assert activity_report(seq, 0.5, 1, 1)[1].first()["f1"] == pytest.approx(1, abs=1e-6)


def test_embedding_scores_by_hand(spark):
    rng = np.random.default_rng(3)
    x, spk = rng.normal(size=(14, 6)), np.array([0] * 5 + [1] * 8 + [2])
    df = spark.createDataFrame([(i, int(s), v.tolist()) for i, (s, v) in enumerate(zip(spk, x))], "uttid long, spk int, dvec array<double>")
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = []
    for i in range(14):
        own = [far[i, j] for j in range(14) if spk[j] == spk[i] and j != i]
        b = min(far[i, spk == s].mean() for s in set(spk) - {spk[i]})
        want.append((b - np.mean(own)) / max(b, np.mean(own)) if own else 0)
    for block in (3, 1024):
        got = {r["uttid"]: r["silhouette"] for r in embeddings.silhouette(df, block=block).collect()}
        assert [got[i] for i in range(14)] == pytest.approx(want)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    total = 0
    for i in range(14):
        cs = []
        for s in range(3):
            sel = (spk == s) & (np.arange(14) != i) if s == spk[i] and (spk == s).sum() > 1 else spk == s
            m = u[sel].mean(0)
            cs.append(10 * max(u[i] @ m / np.linalg.norm(m), 1e-6) - 5)
        total += np.log(np.exp(cs).sum()) - cs[spk[i]]
    assert embeddings.ge2e_loss(df).first()["loss"] == pytest.approx(total)
    by_spk, middle = embedding_report(df)
    assert by_spk.count() == middle.count() == 3
    assert embeddings.left_out(df).filter("spk = 2").first()["others"] is None
    with pytest.raises(ValueError):
        embeddings.ge2e_loss(df, "other")


def test_family_at_once_is_each_member_alone(spark):
    rng = np.random.default_rng(5)
    rows = [(k // 2, rng.normal(size=20).tolist(), rng.normal(size=20).tolist()) for k in range(8)]
    pairs = spark.createDataFrame(rows, "key long, enh array<double>, clean array<double>")
    got = {r["kind"]: r["loss"] for r in scores.family_losses(pairs).collect()}
    assert got == {k: pytest.approx(scores.sdr_loss(pairs, k).first()["loss"]) for k in scores.FAMILY}
    assert {r["loss"] for r in scores.family_losses(pairs.limit(0)).collect()} == {None}


def test_far_speakers_are_not_met(spark):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(30, 8)) * 3
    spk = rng.integers(0, 30, 600)
    spk[:3] = [100, 101, 101]
    x = np.where(spk[:, None] < 30, middle[spk % 30], 0) + 0.5 * rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, int(s), v.tolist()) for i, (s, v) in enumerate(zip(spk, x))], "uttid long, spk int, dvec array<double>")
    asked = embeddings.rivals(df, block=100).collect()
    sizes = {int(s): int((spk == s).sum()) for s in set(spk)}
    pairs = sum(sizes[r["other"]] for r in asked) + sum(n * n for n in sizes.values())
    assert pairs < 0.2 * 600 * 600 and not any(spk[r["uttid"]] == r["other"] for r in asked)
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    by = {s: far[:, spk == s].mean(1) for s in sizes}
    got = {r["uttid"]: r for r in embeddings.silhouette(df, block=50).collect()}
    for i in range(600):
        assert got[i]["b"] == pytest.approx(min(by[s][i] for s in sizes if s != spk[i]))
    one = embeddings.silhouette(df.filter("spk = 101")).collect()
    assert len(one) == 2 and all(r["b"] is None and r["silhouette"] == 0 for r in one)
    assert embeddings.silhouette(df.limit(0)).count() == 0


def test_silhouette_blocks_grow_with_the_table(spark, monkeypatch):
    """Blocks by the table's size, by a bound in bytes and given ones, with several pieces to a block, agree."""
    import numpy as np

    from earshot.operators import embeddings

    rng = np.random.default_rng(2)
    rows = [(i, i % 2, rng.normal(0, 1, 3).tolist()) for i in range(2200)]
    df = spark.createDataFrame(rows, "uttid long, spk int, dvec array<double>")
    of = lambda **k: {r["uttid"]: (r["a"], r["b"]) for r in embeddings.silhouette(df, **k).collect()}
    want = of(block=2000)
    x, spk = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for i in (0, 7, 2199):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert np.allclose(want[i], (d[spk == spk[i]].sum() / 1099, d[spk != spk[i]].mean()))
    monkeypatch.setattr(embeddings, "LEAST_ROWS", 200)
    monkeypatch.setattr(embeddings, "PARTS", 4)
    for most in (1 << 24, 24 * 300):
        monkeypatch.setattr(embeddings, "BLOCK_BYTES", most)
        got = of()
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
