import numpy as np
import pytest

from earshot.functions import kernels
from earshot.operators import blocks


def recordings(spark, seed=0):
    rng = np.random.default_rng(seed)
    w = {f"k{n}": rng.normal(size=n) for n in (1, 7, 16, 40, 41, 333)}
    return w, spark.createDataFrame([(k, x.tolist()) for k, x in w.items()] + [("none", None), ("empty", [])], "key string, w array<double>")


def one_row(df):
    return {r["key"]: np.array(r["w"]) for r in blocks.whole(df).collect()}


@pytest.mark.parametrize("size", [5, 16, 50, 1000])
def test_equal_to_one_row(spark, size):
    w, rows = recordings(spark)
    cut = blocks.cut(rows, size)
    back = one_row(cut)
    assert back.keys() == w.keys() and all(np.array_equal(back[k], w[k]) for k in w)
    assert cut.filter(f"size(samples) > {size}").count() == 0
    frames = blocks.spectra(cut, 16, 6, size)
    got = {(r["key"], r["frame"]): np.array([r["re"], r["im"]]) for r in frames.collect()}
    want = {(k, f): np.array(z) for k, x in w.items() for f, z in enumerate(zip(*kernels.stft(x, 16, 6)))}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    again = one_row(blocks.waveforms(frames, 16, 6, size))
    for k, x in w.items():
        re, im = kernels.stft(x, 16, 6)
        assert (k in again) == (len(re) > 0) and (k not in again or np.allclose(again[k], kernels.istft(re, im, 16, 6)))


@pytest.mark.parametrize("size", [5, 50, 1000])
def test_filters_reach_over_many_blocks(spark, size):
    w, rows = recordings(spark, 1)
    rng = np.random.default_rng(2)
    h = {k: rng.normal(size=n) for k, n in zip(w, (3, 31, 12, 60, 25, 100))}
    lead = {k: int(np.abs(x).argmax()) for k, x in h.items()}
    taps = spark.createDataFrame([(k, x.tolist(), lead[k]) for k, x in h.items()] + [("other", [1.0], 0)], "key string, taps array<double>, lead long")
    got = one_row(blocks.filtered(blocks.cut(rows, size), taps, size))
    assert got.keys() == w.keys() and all(np.allclose(got[k], np.r_[np.convolve(w[k], h[k]), np.zeros(len(w[k]))][lead[k] : lead[k] + len(w[k])]) for k in w)
    rooms = spark.createDataFrame([(k, x.tolist()) for k, x in h.items()], "key string, h array<double>")
    for mode in ("image", "direct", "early"):
        got = one_row(blocks.filtered(blocks.cut(rows, size), blocks.room_taps(rooms, 300, mode), size))
        assert all(np.allclose(got[k], kernels.reverberated(w[k], h[k], 300, mode)) for k in w)
    silent = spark.createDataFrame([("k7", None, 0), ("k16", [], 0)], "key string, taps array<double>, lead long")
    assert {k: x.tolist() for k, x in one_row(blocks.filtered(blocks.cut(rows, size), silent, size)).items()} == {"k7": [0.0] * 7, "k16": [0.0] * 16}


def test_pieces_make_recordings(spark):
    rng = np.random.default_rng(3)
    pieces = [(k, n, rng.normal(size=int(rng.integers(0, 40))).tolist() or None) for k in "ab" for n in range(30)]
    rng.shuffle(pieces)
    rows = spark.createDataFrame([(str(k), int(n), w) for k, n, w in pieces], "key string, nth int, w array<double>")
    got = one_row(blocks.joined(rows, "nth", 64))
    want = {k: np.concatenate([w for a, _, w in sorted(pieces, key=lambda p: p[1]) if a == k and w]) for k in "ab"}
    assert all(np.array_equal(got[k], want[k]) for k in "ab")
    assert {r["key"]: r["n"] for r in blocks.sizes(blocks.joined(rows, "nth", 64)).collect()} == {k: len(x) for k, x in want.items()}


def test_a_long_recording_is_in_no_single_task(spark):
    """One recording of 2,000 blocks: the exchange deals it to all partitions."""
    from pyspark.sql import functions as F

    rows = spark.range(2000).select(F.lit("long").alias("key"), F.col("id").alias("block"), F.array_repeat(F.lit(1.0), 32).alias("samples"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = blocks.spectra(rows, 16, 8, 32).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = sum(r["count"] for r in shares)
    assert n == (2000 * 32 - 16) // 8 + 1 and len(shares) == 4 and max(r["count"] for r in shares) < 0.3 * n
