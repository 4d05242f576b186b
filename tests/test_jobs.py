import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import kernels, signal
from earshot.jobs import augment, datasets, losses
from earshot.operators import embeddings, scores, spectral
from earshot.sources import audio


def waves(spark, n=4, size=400, seed=0):
    rng = np.random.default_rng(seed)
    return {k: rng.normal(size=size) for k in range(n)}


def table(spark, of, schema="key long, w array<double>"):
    return spark.createDataFrame([(k, w.tolist()) for k, w in of.items()], schema)


def test_white_noise_reaches_the_ratio_and_repeats(spark):
    of = waves(spark, 3, 5000)
    rows = table(spark, of)
    got = {r["key"]: np.array(r["x"]) - of[r["key"]] for r in augment.with_white_noise(rows, 10.0).collect()}
    for k, noise in got.items():
        assert 10 * np.log10((of[k] ** 2).sum() / (noise**2).sum()) == pytest.approx(10, abs=0.3)
    again = {r["key"]: r["x"] for r in augment.with_white_noise(rows.repartition(3), 10.0).collect()}
    assert all(np.allclose(np.array(again[k]) - of[k], got[k]) for k in got) and not np.allclose(got[0], got[1])


def test_mel_bands_back_to_waves(spark):
    of = {0: np.cos(np.arange(512) * 0.3), 1: np.zeros(10)}
    rows = signal.from_mels(signal.mels(table(spark, of), 16000, 64, 16, 20, phase=True), 16000, 64, 16)
    got = {r["key"]: np.array(r["back"]) for r in rows.collect()}
    want = kernels.from_mel_spectrogram(kernels.mel_spectrogram(of[0], 16000, 64, 16, 20), np.angle(np.fft.rfft(kernels.frames(of[0], 64, 16) * kernels.hann(64), axis=1)), 16000, 64, 16)
    assert got[0] == pytest.approx(want) and len(got[1]) == 0
    # Power is shared out among bins, so the tone comes back in phase though not in full.
    assert np.corrcoef(got[0][64:-64], of[0][64 : len(got[0]) - 64])[0, 1] > 0.9


def test_resampling_to_one_rate(spark):
    t = np.arange(800) / 8000
    rows = spark.createDataFrame([(0, 8000, np.sin(2 * np.pi * 440 * t).tolist()), (1, 16000, [1.0, 2.0]), (2, 8000, None), (3, None, [3.0]), (4, 8000, [])], "key long, sample_rate int, w array<double>")
    got = {r["key"]: r for r in signal.resampled(rows, 16000, ["w"]).collect()}
    want = np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert np.abs(np.array(got[0]["w"])[100:-100] - want[100:-100]).max() < 0.02
    assert (got[1]["w"], got[2]["w"], got[3]["w"], got[4]["w"]) == ([1.0, 2.0], None, [3.0], []) and {r["sample_rate"] for r in got.values()} == {16000}


def test_datasets_bring_waves_to_their_rate(spark):
    rows = table(spark, waves(spark, 3, 100)).withColumns({"clean": F.col("w"), "sample_rate": F.lit(8000)})
    off = augment.Chances(speed=0.0, rir=0.0, noise=0.0, response=0.0)
    assert {r["n"] for r in datasets.enhancement_set(rows, chances=off).select(F.size("process_wav").alias("n")).collect()} == {200}
    assert {r["n"] for r in datasets.enhancement_set(rows.drop("sample_rate"), chances=off).select(F.size("process_wav").alias("n")).collect()} == {100}


def test_enrollment_modes(spark):
    clips = [("a", 0, "x", [1.0] * 4), ("a", 1, "y", [2.0] * 30), ("a", 2, "z", [3.0] * 8), ("b", 0, "x", [4.0] * 2)]
    df = spark.createDataFrame(clips, "key string, pos int, utt string, w array<double>")
    of = lambda mode: {r["key"]: r["enroll"] for r in datasets.chosen_enrollments(df, mode, sample_rate=5).collect()}
    assert of("longest") == {"a": [2.0] * 30, "b": [4.0] * 2} and of("shortest") == {"a": [1.0] * 4, "b": [4.0] * 2}
    assert of("full") == {"a": [1.0] * 4 + [2.0] * 30 + [3.0] * 8, "b": [4.0] * 2}
    assert len(of("fixed_length")["a"]) in (4, 8, 25)
    drawn = of("drawn")
    assert len(drawn["a"]) >= 5 and drawn["b"] == [4.0] * 2
    with pytest.raises(ValueError):
        of("other")
    rows = spark.createDataFrame([("a", 0, "p", "p", [0.5] * 9, [0.1] * 9), ("b", 1, "q", "q", [0.5] * 9, [0.1] * 9)], "key string, idx long, spk string, all_spks string, w array<double>, clean array<double>")
    made = datasets.extraction_set(rows, df, sample_rate=5, enroll_mode="longest", chances=augment.Chances(0, 0, 0, 0)).collect()
    assert {r["key"]: r["enroll"] and len(r["enroll"]) for r in made} == {"a": 30, "b": None}


def test_wave_files_and_activity_labels(spark, tmp_path):
    rows = spark.createDataFrame([("u/1", 8000, [0.5, -0.5]), ("u2", 16000, [0.25])], "uttid string, sample_rate int, w array<double>")
    files = {r["uttid"]: r["path"] for r in audio.write_wave_files(rows, str(tmp_path / "wav"), 4).collect()}
    read = {r["path"].split("/")[-1]: (r["sample_rate"], r["w"]) for r in audio.waves(spark, str(tmp_path / "wav")).collect()}
    assert sorted(read.values()) == [(8000, [0.5, -0.5]), (16000, [0.25])] and len(read) == 2
    assert all(audio.decode(open(p, "rb").read())[1].shape[0] == 1 for p in files.values())
    labels = spark.createDataFrame([("k", 1, 1), ("k", 0, 0), ("m", 0, 1)], "key string, pos long, label int")
    audio.write_activity(labels, str(tmp_path / "out"), 100)
    lines = dict(r["value"].split(" ") for r in spark.read.text(str(tmp_path / "out" / "ref2vad.txt")).collect())
    assert {k: audio.decode(open(p, "rb").read())[1][0].tolist() for k, p in lines.items()} == {"k": [0.0, 1.0], "m": [1.0]}


def test_losses_by_name(spark):
    rng = np.random.default_rng(3)
    pairs = spark.createDataFrame([(str(k), rng.normal(size=1200).tolist(), rng.normal(size=1200).tolist()) for k in range(3)], "key string, enh array<double>, clean array<double>")
    value = lambda name, **kw: losses.loss(name, **kw)(pairs).first()["loss"]
    each = spectral.spectral_losses(pairs).agg(F.avg("stft_loss").alias("s"), F.avg("over_suppression").alias("o")).first()
    sisnr = scores.sdr_loss(pairs, "sisnr").first()["loss"]
    assert (value("stft_ov"), value("sisnr_stft"), value("sisnr_ov")) == pytest.approx((each["s"] + each["o"], sisnr + each["s"], sisnr + each["o"]))
    assert value("own + sdr", user={"own": losses.by_rows(lambda x, y, off: F.when(off, 0.0).otherwise(F.size(x).cast("double")))}) == pytest.approx(1200 + scores.sdr_loss(pairs, "sdr").first()["loss"])
    speakers = spark.createDataFrame([(k, k % 3, rng.normal(size=8).tolist()) for k in range(12)], "uttid long, spk int, dvec array<double>")
    weights = embeddings.centroids(speakers).select("spk", F.col("centroid").alias("weight"))
    assert losses.loss("ge2e")(speakers).first()["loss"] > 0 and losses.loss("aamsoftmax", classes=weights)(speakers).first()["loss"] > 0
    with pytest.raises(KeyError):
        losses.loss("other")


@pytest.mark.parametrize("block", [1, 5, 1024])
def test_speaker_losses_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(20, 6))
    v = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    spk = np.arange(20) % 7
    rows = spark.createDataFrame([(i, int(spk[i]), v[i].tolist(), 0.5) for i in range(20)], "uttid long, spk int, v array<double>, own double")
    classes = spark.createDataFrame([(int(k), v[k].tolist()) for k in range(7)], "spk int, v array<double>")
    got = embeddings._against_others(rows, classes, lambda x: 3 * x, 3.0, block).orderBy("uttid").collect()
    s = 3 * v @ v[:7].T
    off = spk[:, None] != np.arange(7)[None, :]
    assert [r["rest"] for r in got] == pytest.approx((np.exp(s - 3) * off).sum(1)) and [r["best"] for r in got] == pytest.approx(np.where(off, s, -9).max(1))


def test_permutations_by_arithmetic(spark):
    from earshot.operators import picks

    sizes = [*range(1, 30), 97, 1000, 4097]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    for epoch in (0, 1):
        there = rows.withColumn("p", picks.permuted(F.col("i"), F.col("n"), epoch, seed=3))
        found = {n: [] for n in sizes}
        for r in there.withColumn("b", picks.permuted(F.col("p"), F.col("n"), epoch, seed=3, back=True)).orderBy("n", "i").collect():
            assert r["b"] == r["i"]
            found[r["n"]].append(r["p"])
        assert all(sorted(p) == list(range(n)) for n, p in found.items())
        p = np.array(found[4097])
        # As mixed as a drawn order: neighbours are a third of the range apart.
        assert abs(np.abs(np.diff(p)).mean() / 4097 - 1 / 3) < 0.02 and abs(np.corrcoef(p, np.arange(4097))[0, 1]) < 0.06
    other = [r["p"] for r in rows.filter("n = 1000").withColumn("p", picks.permuted(F.col("i"), F.col("n"), 7, seed=3)).orderBy("i").collect()]
    assert sum(a == b for a, b in zip(other, found[1000])) < 20
    batches = picks.permuted_batches(spark.range(100).withColumnRenamed("id", "idx"), 32, 100)
    assert {r["batch"]: r["count"] for r in batches.groupBy("batch").count().collect()} == {0: 32, 1: 32, 2: 32, 3: 4}
