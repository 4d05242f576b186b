import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.sources import wav_source as W


def wav(x, bits, form=1, channels=1, rate=8000, before=b"", extensible=False, size=None):
    """A WAV file by hand from samples in [-1, 1)."""
    x = np.asarray(x)
    if form == 3:
        raw = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        raw = (x * 128 + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        raw = b"".join(struct.pack("<i", int(v * 2**23))[:3] for v in x)
    else:
        raw = (x * 2 ** (bits - 1)).astype(f"<i{bits // 8}").tobytes()
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else form, channels, rate, rate * block, block, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 0, form) + b"\0" * 14
    chunks = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + before + b"data" + struct.pack("<I", len(raw) if size is None else size) + raw
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


X = (np.arange(-60, 60) / 64).clip(-1, 0.99)


@pytest.fixture
def folder(tmp_path):
    tags = b"LIST" + struct.pack("<I", 70_001) + b"t" * 70_002
    files = {
        "pcm8": wav(X, 8), "pcm16": wav(X, 16), "pcm24": wav(X, 24), "pcm32": wav(X, 32), "f32": wav(X, 32, 3), "f64": wav(X, 64, 3),
        "stereo": wav(np.repeat(X, 2) * np.tile([1, -1], 120), 16, channels=2), "tags": wav(X, 16, before=tags), "ext": wav(X, 24, extensible=True), "stream": wav(X, 16, size=0xFFFFFFFF), "none": wav([], 16),
    }
    (tmp_path / "in" / "deep.er").mkdir(parents=True)
    for k, data in files.items():
        (tmp_path / "in" / "deep.er" / f"a.{k}.wav").write_bytes(data)
    (tmp_path / "in" / ".hidden.wav").write_bytes(b"x")
    return tmp_path


def test_headers_take_few_bytes():
    for before, most in ((b"", W.HEAD), (b"LIST" + struct.pack("<I", 500_000) + b"t" * 500_000, W.HEAD + 8)):
        data = wav(np.zeros(400_000), 16, before=before)
        window = W.Window(io.BytesIO(data), len(data))
        assert W.read_header(window).frames == 400_000 and window.taken <= most


def test_headers_and_all_widths(spark, folder):
    got = {r["uttid"]: r for r in W.headers(spark, str(folder / "in")).collect()}
    assert len(got) == 11 and all((r["sample_rate"], r["frames"]) == (8000, 0 if k == "a_none" else 120) for k, r in got.items())
    assert got["a_stereo"]["channels"] == 2
    rows = W.recordings(spark, str(folder / "in"), block=50).filter("block IS NOT NULL").orderBy("block").collect()
    for k in got:
        x = np.concatenate([r["samples"] for r in rows if r["uttid"] == k] or [[]])
        assert k == "a_none" and not len(x) or np.allclose(x, X, atol=1 / 64 if k == "a_pcm8" else 1e-4), k
    assert {(r["block"], len(r["samples"])) for r in rows} == {(0, 50), (1, 50), (2, 20)}


def test_a_long_file_is_read_by_several_tasks(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-1, 1, 50_000).astype(np.float32)
    (tmp_path / "long.wav").write_bytes(wav(x, 32, 3))
    for split in (1000, 30_000, 10**9):
        rows = W.recordings(spark, str(tmp_path), block=700, split=split).withColumn("task", F.spark_partition_id()).orderBy("block").collect()
        assert np.array_equal(np.concatenate([r["samples"] for r in rows]).astype(np.float32), x) and [r["block"] for r in rows] == list(range(72))
        assert len({r["task"] for r in rows}) >= min(72, 200_000 // split // 2)


def test_bad_files_are_named(spark, folder):
    (folder / "in" / "bad.wav").write_bytes(b"RIFX" + b"0" * 90)
    (folder / "in" / "short.wav").write_bytes(b"RI")
    got = W.headers(spark, str(folder / "in"), strict=False)
    assert sorted(r["uttid"] for r in got.filter("problem IS NOT NULL").collect()) == ["bad", "short"] and got.count() == 13
    assert W.recordings(spark, str(folder / "in"), strict=False).filter("problem IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="no WAV file"):
        W.headers(spark, str(folder / "in")).collect()


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(f"u/{k}", 16000, [k / 8] * k) for k in range(1, 7)] + [("null", 16000, None)], "uttid string, sample_rate int, w array<double>").repartition(3)
    path = str(tmp_path / "out")
    W.save(rows, path, folders=4)
    W.save(rows, path, folders=4)
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert sorted(p.name for p in files) == [f"u%2F{k}.wav" for k in range(1, 7)] and not list((tmp_path / "out").glob(".wav-*"))
    assert {(r["uttid"], tuple(r["samples"])) for r in W.recordings(spark, path).collect()} == {(f"u%2F{k}", (k / 8,) * k) for k in range(1, 7)}
    boom = rows.withColumn("sample_rate", F.when(F.col("uttid") == "u/6", F.raise_error(F.lit("boom"))).otherwise(F.col("sample_rate")))
    with pytest.raises(Exception, match="boom"):
        W.save(boom, str(tmp_path / "failed"))
    assert not [p for p in (tmp_path / "failed").rglob("*") if p.is_file()]
