import numpy as np
import pytest

from earshot.functions import kernels
from earshot.jobs import augment, datasets, registry
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(name, same_as_sql):
    assert same_as_sql(registry.QUERIES[name], registry.SQL[name]) > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_frames_come_back(spark):
    """Overlap-add of frames whose overlaps agree gives the samples themselves."""
    waves = {}
    for r in registry.views.waves(spark, SF).orderBy("key").collect():
        waves.setdefault(f"{r['spk']}-{r['key'] // registry.SESSION}", []).extend(r["w"])
    got = {}
    for r in registry.session_samples(spark, SF).orderBy("start").collect():
        got.setdefault(r["stream_id"], []).extend(r["samples"])
    assert all(got[k] == pytest.approx(w[: len(got[k])]) and len(w) - len(got[k]) == 16 for k, w in waves.items())


def collected(spark, query):
    return {r["key"]: r for r in query(spark, SF).collect()}


def test_queries_without_sql_against_the_kernels(spark):
    """Noise, mel bands and spectral losses cannot be said in SQL; each value is computed again from the waves."""
    w = {r["key"]: np.array(r["w"]) for r in registry.views.waves(spark, SF).collect()}
    noisy = collected(spark, registry.white_noise_waves)
    assert noisy.keys() == w.keys() and len({tuple((np.array(noisy[k]["x"]) - w[k]).round(9)) for k in w}) == len(w)
    noise = np.concatenate([np.array(noisy[k]["x"]) - w[k] for k in w])
    assert (noise**2).mean() / np.mean([(x**2).mean() for x in w.values()]) == pytest.approx(0.1, rel=0.03) and abs(noise.mean()) < 0.01
    back = collected(spark, registry.mel_round_trip)
    for k, x in w.items():
        re, im = kernels.stft(x, 32, 16)
        assert back[k]["back"] == pytest.approx(kernels.from_mel_spectrogram(kernels.mel_spectrogram(x, 16000, 32, 16, 6), np.arctan2(im, re), 16000, 32, 16))
    long = {}
    for r in registry.views.trios(spark, SF).orderBy("key").collect():
        for side in ("enh", "clean"):
            long.setdefault((f"{r['spk']}-{r['key'] // registry.SESSION}", side), []).extend(r[side])
    found = {r["speaker"]: r for r in registry.spectral_losses(spark, SF).collect()}
    assert found.keys() == {k for k, _ in long}
    for k, r in found.items():
        a, b = np.array(long[k, "enh"]), np.array(long[k, "clean"])
        if len(a) > 1024:
            off, whole, _ = kernels.spectral_terms(a, b, *kernels.RESOLUTIONS[0])
            assert (r["stft_loss"], r["over_suppression"], r["off"], r["whole"]) == pytest.approx((kernels.spectral_loss(a, b), kernels.over_suppression(a, b), off, whole))
    summary = registry.spectral_summary(spark, SF).first()
    known = [r for r in found.values() if r["off"] is not None]
    assert summary["n"] == len(known) and summary["convergence"] == pytest.approx(np.sqrt(sum(r["off"] for r in known) / sum(r["whole"] for r in known)))


def test_reports_are_written(spark, tmp_path):
    from earshot.sources.text import write_report

    scored = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "uttid string, sisnr double")
    write_report(scored, scored.groupBy().avg("sisnr"), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 2
    assert spark.read.csv(str(tmp_path / "summary"), header=True).first()[0] == "2.0"


def test_speed_and_volume_always_change(spark):
    rows = registry.views.trios(spark, SF).select("key", registry.F.col("noisy").alias("w"), "clean")
    made = datasets.enhancement_set(rows, chances=augment.SPEED_AND_VOLUME).collect()
    for r in made[:40]:
        assert 0.8 <= r["speed"] <= 1.2 and 0.125 <= r["volume"] <= 2
        for side, of in (("process_wav", "w"), ("clean_wav", "clean")):
            assert r[side] == pytest.approx(np.clip(kernels.changed_speed(np.array(r[of]), r["speed"]) * r["volume"], -1, 1))


def test_extraction_draws_as_often_as_its_sql(spark, tmp_path):
    """One row of another speaker among many of one: most rows draw it in none of eight draws; a row without a label has no interferer."""
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.1, 20).tolist(), None if i == 3 else 5 if i == 7 else 0) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    names = ["key", "i", "other_idx", "inactive", "process", "clean", "enroll"]
    want = c.execute(f"SELECT {', '.join(names)} FROM ({registry.SQL['extraction_examples']}) ORDER BY key, i").fetchall()
    got = registry.extraction_examples(spark, str(tmp_path)).select(*names).orderBy("key", "i").collect()
    assert any(r["other_idx"] is None for r in got) and any(r["other_idx"] is not None for r in got)
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    for r, w in zip(got, want):
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 2e-5) for x, y in zip(tuple(r)[4:], w[4:]))
