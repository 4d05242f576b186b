import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import kernels, signal, waves
from earshot.jobs import augment, datasets, models
from earshot.operators.scores import METRICS, metric
from earshot.sources import audio


def one(spark, f, *arrays):
    df = spark.createDataFrame([tuple([float(x) for x in a] for a in arrays)], ", ".join(f"c{i} array<double>" for i in range(len(arrays))))
    return df.select(f(*(F.col(c) for c in df.columns))).first()[0]


def test_levels(spark):
    assert one(spark, lambda w: waves.normalized(w), [1, -3]) == pytest.approx([0.5, -1.5])
    assert one(spark, lambda w: waves.rescaled(w, 20.0, "peak", "dB"), [1, -4]) == pytest.approx([2.5, -10])
    assert one(spark, lambda w: waves.rescaled(w, 1.0), [0, 0]) == [0, 0]
    assert one(spark, lambda w: waves.dropped(w, 0.5, 0.9), range(1, 9)) == [1, 2, 3, 4, 0, 0, 0, 0]
    assert one(spark, lambda w: waves.cut(w, F.lit(1), 2), [1, 2, 3]) == [2, 3]
    assert one(spark, lambda w: waves.cut(w, F.lit(0), 4), [1, 2, 3]) == [1, 2, 3, 0]
    assert one(spark, lambda a, b: waves.aligned(a, b), [1, 2], [0, 0, 0]) == [0, 1, 2]
    assert one(spark, lambda n: waves.fitted_noise(n, F.lit(5), F.lit(0)), [1, 2]) == [1, 2, 1, 2, 1]
    assert one(spark, lambda n: waves.fitted_noise(n, F.lit(2), F.lit(0)), [1, 2]) == [1, 2]


def test_noise_reaches_the_ratio(spark):
    rng = np.random.default_rng(0)
    w, n = rng.normal(size=100), 3 * rng.normal(size=100)
    got = np.array(one(spark, lambda a, b: waves.noisy(a, b, F.lit(10.0), "power"), w, n)) - w
    assert 10 * np.log10((w @ w) / (got @ got)) == pytest.approx(10, abs=1e-6)
    ref = np.array(one(spark, lambda a, b: waves.noisy(a, b, F.lit(10.0)), w, n)) - w
    assert 10 * np.log10((w @ w) / (ref @ ref)) == pytest.approx(10 + 10 * np.log10(np.linalg.norm(w) / np.linalg.norm(n)), abs=1e-6)


def test_mel_scale_values(spark):
    hz = [60, 110, 220, 440]
    assert one(spark, lambda a: F.transform(a, waves.mel), hz) == pytest.approx([0.9, 1.65, 3.3, 6.6])
    assert one(spark, lambda a: F.transform(a, waves.hertz), [0, 1, 2, 3, 4]) == pytest.approx([0, 66.667, 133.333, 200, 266.667], abs=1e-3)
    centres = spark.range(1).select(waves.mel_centres(40, 0, 8000)).first()[0]
    assert centres[1] == pytest.approx(77.343, abs=1e-2) and centres[-2] == pytest.approx(7386.689, abs=0.1) and centres[-1] == pytest.approx(8000)
    bins = spark.range(1).select(waves.bin_centres(16000, 512)).first()[0]
    assert len(bins) == 257 and bins[1] == 31.25 and bins[-1] == 8000


def test_masks_by_complex_numbers(spark):
    rng = np.random.default_rng(1)
    a, b, c, d = rng.normal(size=(4, 9))
    z, m = a + 1j * b, c + 1j * d
    assert one(spark, lambda *x: waves.complex_masked(*x)[0], a, b, c, d) == pytest.approx((z * m).real.tolist())
    polar = np.abs(z) * np.tanh(np.abs(m)) * np.exp(1j * (np.angle(z) + np.angle(m)))
    assert one(spark, lambda *x: waves.polar_masked(*x)[1], a, b, c, d) == pytest.approx(polar.imag.tolist())
    small = np.abs(z) ** 0.3 * np.exp(1j * np.angle(z))
    assert one(spark, lambda x, y: waves.compressed(x, y)[1], a, b) == pytest.approx(small.imag.tolist())


def test_resampling_keeps_a_tone():
    t = np.arange(4000)
    w = np.sin(2 * np.pi * 200 * t / 8000)
    up = kernels.resample(w, 8000, 16000)
    assert len(up) == 8000
    assert np.abs(up - np.sin(2 * np.pi * 200 * np.arange(8000) / 16000))[200:-200].max() < 2e-2
    assert abs(len(kernels.changed_speed(w, 1.1)) - 4000 / 1.1) <= 1
    assert len(kernels.resample(np.empty(0), 8000, 16000)) == 0


def test_convolution_and_rooms():
    rng = np.random.default_rng(2)
    x, h = rng.normal(size=50), rng.normal(size=7)
    for mode in ("full", "same", "valid"):
        assert kernels.convolve(x, h, mode) == pytest.approx(np.convolve(x, h, mode))
    assert kernels.causal(x, h) == pytest.approx(np.convolve(x, h)[:50])
    spike = np.r_[np.zeros(3), 2.0, np.zeros(4)]
    assert kernels.reverberated(x, spike, 16000) == pytest.approx(x)
    assert len(kernels.response(np.r_[np.zeros(10), 1, np.ones(2000)], 16000, "direct")) == 10 + 96


def test_filters():
    response = lambda h, f: abs(np.sum(h * np.exp(-2j * np.pi * f * np.arange(len(h)))))
    low = kernels.pass_band(0, 0.1, 100)
    assert response(low, 0.02) == pytest.approx(1, abs=1e-2) and response(low, 0.3) < 1e-2
    band = kernels.pass_band(0.1, 0.2, 100)
    assert response(band, 0.15) == pytest.approx(1, abs=1e-2) and response(band, 0.02) < 1e-2 and response(band, 0.4) < 1e-2
    gap = kernels.stop_band(0.2, 0.3, 200)
    assert response(gap, 0.25) < 2e-2 and response(gap, 0.05) == pytest.approx(1, abs=1e-2) and response(gap, 0.45) == pytest.approx(1, abs=1e-2)
    with pytest.raises(ValueError):
        kernels.without_band(np.ones(1000), 16000, 8000, 10)
    w = np.random.default_rng(3).normal(size=30) * 0.1
    y = np.zeros(30)
    for t in range(30):
        y[t] = w[t] + 0.2 * (w[t - 1] if t else 0) + 0.1 * (w[t - 2] if t > 1 else 0) - 0.3 * (y[t - 1] if t else 0) + 0.1 * (y[t - 2] if t > 1 else 0)
    assert kernels.biquad(w, (0.3, -0.1), (0.2, 0.1)) == pytest.approx(y)


def test_spectra():
    w = np.random.default_rng(4).normal(size=2000)
    re, im = kernels.stft(w, 512, 128)
    assert re.shape == (12, 257)
    back = kernels.istft(re, im, 512, 128)
    assert back[1:1919] == pytest.approx(w[1:1919])
    cos, sin = kernels.fourier_kernels(512)
    assert (kernels.frames(w, 512, 128) * kernels.hann(512)) @ cos.T == pytest.approx(re, abs=1e-9)
    assert -(kernels.frames(w, 512, 128) * kernels.hann(512)) @ sin.T == pytest.approx(im, abs=1e-9)
    assert kernels.fourier_kernels(512, scale="log")[0].shape == (257, 512)
    mel = kernels.mel_spectrogram(w, 16000, 512, 128, 40)
    assert mel.shape == (12, 40) and (mel >= 0).all()
    with pytest.raises(ValueError):
        kernels.mel_filters(16000, 64, 80)
    again = kernels.from_mel_spectrogram(mel, np.arctan2(im, re), 16000, 512, 128)
    assert len(again) == len(back)
    assert kernels.spectral_loss(w, w) == 0 and kernels.spectral_loss(0.5 * w, w) > 0
    off, whole, _ = kernels.spectral_terms(0.5 * w, w, 512, 50, 240)
    assert np.sqrt(off / whole) == pytest.approx(0.5, abs=1e-2)
    assert kernels.over_suppression(2 * w, w) == 0 and kernels.over_suppression(0.25 * w, w) > 0
    assert len(kernels.stft(w[:100], 512, 128)[0]) == 0


def test_wav_files(spark, tmp_path):
    w = np.array([0.0, 0.5, -0.25], np.float32)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.y.wav").write_bytes(audio.encode(w, 8000))
    (tmp_path / "a/z.wav.bak").write_bytes(b"no")
    assert [r["uttid"] for r in audio.indexed_folder(spark, str(tmp_path)).collect()] == ["x_y"]
    assert tuple(audio.headers(spark, str(tmp_path)).select("sample_rate", "seconds", "channels").first()) == (8000, 0.0, 1)
    r = audio.waves(spark, str(tmp_path)).first()
    assert (r["uttid"], r["w"]) == ("x_y", w.tolist())
    audio.write_waves(spark.createDataFrame([("u", 8000, w.tolist())], "uttid string, sample_rate int, w array<double>"), str(tmp_path / "out"))
    assert audio.read_waves(spark, str(tmp_path / "out")).first()["w"] == w.tolist()
    with pytest.raises(ValueError):
        audio.header(b"RIFF0000WAVE")


def corpus(spark, n=12, size=400):
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", i, str(i % 4), str(i % 4), rng.normal(size=size).tolist(), rng.normal(size=size).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "key string, idx long, spk string, all_spks string, w array<double>, clean array<double>")


def pool(spark, n=3, size=300):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(i, rng.normal(size=size).tolist()) for i in range(n)], "idx long, w array<double>")


def test_enhancement_set(spark):
    rows = corpus(spark)
    made = datasets.enhancement_set(rows, pool(spark), pool(spark, size=50), samples=200)
    got = {r["key"]: r for r in made.collect()}
    assert len(got) == 12 and all(r["augmented"] for r in got.values())
    assert got == {r["key"]: r for r in datasets.enhancement_set(rows.repartition(5), pool(spark), pool(spark, size=50), samples=200).collect()}
    plain = datasets.enhancement_set(rows, chances=augment.Chances(0, 0, 0, 0))
    assert all(r["process_wav"] == r["w"] and r["clean_wav"] == r["clean"] for r in plain.collect())
    broken = rows.withColumn("w", F.transform("w", lambda _: F.lit(float("nan"))))
    assert not any(r["augmented"] or r["speed"] for r in datasets.enhancement_set(broken, chances=augment.Chances(1, 0, 0, 0)).collect())


def test_extraction_and_distance_sets(spark):
    rows = corpus(spark)
    clips = rows.select("key", F.col("clean").alias("enroll"))
    made = datasets.extraction_set(rows, clips, single=0.3, inactive=0.5, noises=pool(spark), sample_rate=100).collect()
    assert {r["inactive"] for r in made} == {True, False}
    assert all(r["clean_wav"] == r["process_wav"] for r in made if r["inactive"])
    assert all(r["enroll"] is not None and r["other_spk"] != r["spk"] for r in made)
    vad = rows.select("key", F.transform("w", lambda _: F.lit(1.0)).alias("labels"))
    active = datasets.extraction_set(rows, clips, inactive=0.5, vad=vad, sample_rate=100).collect()
    assert all((sum(r["labels"]) == 0) == r["inactive"] for r in active)
    far = rows.select("key", "w", F.col("clean").alias("near"), F.transform("w", lambda _: F.lit(0.0)).alias("far"))
    got = datasets.distance_set(far, pool(spark), sample_rate=100).collect()
    assert all(r["far_inactive"] and not r["near_inactive"] and r["far"] == r["process_wav"] for r in got)


def test_models_and_metrics(spark):
    rows = corpus(spark, 3)
    assert all(r["enh"] == r["w"] for r in models.enhanced(rows, lambda w: w).collect())
    clips = rows.select("key", F.lit(0).alias("pos"), "w").union(rows.select("key", F.lit(1), "w"))
    assert {len(r["enh"]) for r in models.extracted(rows.select("key", "w"), clips, lambda w, e: e).collect()} == {800}
    assert models.embeddings(rows.withColumnRenamed("key", "uttid"), lambda w: w[:4]).columns == ["uttid", "spk", "dvec"]
    both = metric("sisnr+mine", {"mine": lambda x, y: F.lit(1.0)})
    got = rows.select(both(F.col("w"), F.col("clean")).alias("a"), METRICS["sisnr"](F.col("w"), F.col("clean")).alias("b")).first()
    assert got["a"] == pytest.approx(got["b"] + 1)


def test_labels_follow_the_speed_and_enrollments_the_volume(spark):
    rng = np.random.default_rng(8)
    labels = [float(v) for v in np.repeat(rng.integers(0, 2, 40), 10)]
    rows = corpus(spark)
    clips = rows.select("key", F.col("clean").alias("enroll"))
    vad = rows.select("key", F.array(*map(F.lit, labels)).alias("labels"))
    chances = augment.Chances(speed=0.7, rir=0, noise=0, response=0, volumes=(0.2, 3.0))
    made = datasets.extraction_set(rows, clips, inactive=0.3, vad=vad, samples=300, chances=chances, sample_rate=100).collect()
    assert {r["inactive"] for r in made} == {True, False} and {r["speed"] is None for r in made} == {True, False}
    still = {r["key"]: r["enroll"] for r in datasets.extraction_set(rows, clips, inactive=0.3, vad=vad, samples=300, chances=augment.Chances(0, 0, 0, 0), sample_rate=100).collect()}
    for r in made:
        assert len(r["labels"]) == len(r["process_wav"])
        own = labels[r["offset"] : r["offset"] + 300]
        want = [0.0] * len(r["labels"]) if r["inactive"] else own if r["speed"] is None else [own[min(int(i * r["speed"] + 0.5), 299)] for i in range(len(r["labels"]))]
        assert r["labels"] == want
        assert r["enroll"] == pytest.approx(np.clip(np.array(still[r["key"]]) * r["volume"], -1, 1))


def test_models_write_files(spark, tmp_path):
    rows = corpus(spark, 3).select("key", (F.transform("w", lambda x: x / 8)).alias("w"))
    got = models.enhanced_files(rows, lambda w: -w, str(tmp_path), 8000)
    assert sorted((r["uttid"], r["sample_rate"], r["frames"], r["problem"]) for r in got.collect()) == [(f"k{i}", 8000, 400, None) for i in range(3)]
    loud = {r["uttid"]: np.array(r["w"]) for r in audio.waves(spark, str(tmp_path), level=-20.0).collect()}
    want = {r["key"]: -np.array(r["w"], np.float32).astype(float) for r in rows.collect()}
    assert all(np.allclose(loud[k], want[k] / np.abs(want[k]).mean() / 10) for k in want)


def test_both_sides_follow_the_mixture(spark):
    rows = corpus(spark)
    near = rows.select("key", "w", F.col("clean").alias("near"), F.transform("w", lambda x: x / 4).alias("far"))
    chances = augment.Chances(speed=0.6, rir=0, noise=0, response=0, volumes=(0.2, 3.0))
    for r in datasets.distance_set(near, chances=chances, sample_rate=100).collect():
        src = {x["key"]: x for x in near.filter(F.col("key") == r["key"]).collect()}[r["key"]] if r["key"] in ("k0", "k1", "k2") else None
        assert len(r["near"]) == len(r["far"]) == len(r["process_wav"])
        if src:
            for side in ("near", "far"):
                x = np.array(src[side])
                want = np.clip((kernels.changed_speed(x, r["speed"]) if r["speed"] else x) * r["volume"], -1, 1)
                assert r[side] == pytest.approx(want)


def test_a_bank_of_phases_is_the_same_resampling():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 100, 1000):
        w = rng.normal(size=n)
        for a, b in ((16000, 24000), (44100, 16000), (8000, 16000), (16000, 8000), (3, 7)):
            got = kernels.resample(w, a, b)
            # A rate that is off by nothing but has no small ratio goes sample by sample.
            want = kernels.resample(w, a * (1 + 1e-15) + 1e-12, b)
            assert len(got) == int(np.ceil(n * b / a)) and got == pytest.approx(want[: len(got)], abs=1e-6)


def test_bands_and_spectrogram_masks(spark):
    t = np.arange(4000) / 16000
    rows = spark.createDataFrame([(0, (np.sin(2 * np.pi * 300 * t) + np.sin(2 * np.pi * 2000 * t) + np.sin(2 * np.pi * 6000 * t)).tolist(), 1000.0, 3000.0), (1, [], 1.0, 2.0), (2, None, 1.0, 2.0)], "key long, w array<double>, low double, high double")
    for kind, kept in (("low", (1, 1, 0)), ("band", (0, 1, 0))):
        got = {r["key"]: r["x"] for r in signal.band_filtered(rows, 16000, kind, "low", "high").collect()}
        size = [abs(np.exp(-2j * np.pi * f * t[1000:3000]) @ np.array(got[0])[1000:3000]) / 1000 for f in (300, 2000, 6000)]
        assert size == pytest.approx(kept, abs=0.02) and got[1] == [] and got[2] is None
    frames = spark.range(200).select(F.col("id").alias("key"), F.array_repeat(F.array_repeat(F.lit(1.0), 12), 30).alias("s"))
    masked = frames.withColumn("s", waves.masked_spectrogram(F.col("s"), F.col("key"), (2, 10), (1, 5)))
    spans = set()
    for r in masked.collect():
        x = np.array(r["s"])
        rows_, bins = (x == 0).all(1), (x == 0).all(0)
        assert ((x == 0) == (rows_[:, None] | bins[None, :])).all() and rows_.sum() <= 18 and bins.sum() <= 4
        spans.add((int(rows_.sum()), int(bins.sum())))
    assert len(spans) > 20
    assert waves.masked_spectrogram is not None and frames.select(waves.masked_spectrogram(F.col("s"), F.col("key"), (0, 9), (0, 9)).alias("s")).first()["s"] == [[1.0] * 12] * 30
