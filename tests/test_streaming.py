import numpy as np
from pyspark.sql import functions as F

from earshot.streaming import chunks

CHUNK = "stream_id string, seq long, samples array<double>, eos boolean"


def run(spark, tmp_path, batches, make, columns, **more):
    """Each batch is one file and one micro-batch."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, CHUNK).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = chunks.streamed(source, make, columns, **more).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def split(x, n):
    return [x[i : i + n].tolist() for i in range(0, len(x), n)]


def test_smoothing_streams_as_in_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = {s: rng.random(40) for s in "ab"}
    rows = [[(s, k, c, False) for s in "ab" for k, c in enumerate(split(x[s], 5)) if k // 3 == part] for part in range(3)]
    rows[1] = rows[1][::-1] + [("a", 0, [9.0], False)]  # disorder within a batch, and a late chunk
    make = lambda: chunks.Smoothing(4, 0.5)
    live = run(spark, tmp_path, rows, make, chunks.Smoothing.columns)
    flat = spark.createDataFrame([r for b in rows for r in b if r[2] != [9.0]], CHUNK)
    assert live == sorted(tuple(r) for r in chunks.batched(flat, make, chunks.Smoothing.columns).collect())
    means = [m for s, _, m, _ in live if s == "a"]
    assert np.allclose(means, [np.r_[np.zeros(3), x["a"]][i : i + 4].sum() / 4 for i in range(40)], atol=1e-12)


def test_frames_and_overlap_add(spark):
    x = np.arange(1.0, 101)
    rows = spark.createDataFrame([("a", k, c, k == 9) for k, c in enumerate(split(x, 10))], CHUNK)
    got = chunks.batched(rows, lambda: chunks.Hops(4), chunks.Hops.columns).orderBy("frame").collect()
    hops = [x[10 * k + 4 * j : 10 * k + 4 * j + 4] for k in range(10) for j in range(2)]
    assert [r["samples"] for r in got] == [np.r_[a, b].tolist() for a, b in zip(hops, hops[1:])]
    add = chunks.OverlapAdd(4, 2)
    out = [r for f in ([1, 1, 3, 3], [5, 5, 7, 7]) for r in add.push(np.array(f, float))] + add.finish()
    assert [(s, v.tolist()) for s, v in out] == [(0, [1, 1]), (2, [4, 4]), (4, [7, 7])]


def test_segment_state_and_sessions(spark, tmp_path):
    make = lambda: chunks.Steps(lambda f, fast, slow: (f * 0 + (fast or 0) + 10 * (slow or 0), (fast or 0) + 1), lambda fast, slow: (slow or 0) + 1, 3)
    rows = spark.createDataFrame([("a", k, [0.0], False) for k in range(7)], CHUNK)
    got = chunks.batched(rows, make, chunks.Steps.columns).orderBy("frame").collect()
    assert [r["samples"][0] for r in got] == [0, 1, 2, 10, 11, 12, 20]
    parts = [[("a", 0, [1.0], False), ("b", 0, [5.0], False)], [("a", 1, [2.0, 3.0], True)], [("a", 0, [7.0], True)]]
    live = run(spark, tmp_path, parts, lambda: chunks.Session(lambda w: np.array([w.sum()])), chunks.Session.columns)
    assert live == [("a", 1, [7.0]), ("a", 3, [6.0])]


def test_null_samples_and_empty(spark):
    rows = spark.createDataFrame([("a", 0, None, False), ("a", 1, [], False), ("a", 2, [1.0], False)], CHUNK)
    assert chunks.batched(rows, lambda: chunks.Smoothing(2, 0.1), chunks.Smoothing.columns).select("mean").first()[0] == 0.5
    assert chunks.batched(rows.filter(F.lit(False)), lambda: chunks.Smoothing(2, 0.1), chunks.Smoothing.columns).count() == 0


def test_late_and_repeated_chunks_are_counted(spark, tmp_path):
    make = lambda: chunks.Smoothing(1, 0.5)
    parts = [[("a", 0, [1.0], False)], [("a", 0, [9.0], False)], [("a", 1, [2.0], False), ("a", 1, [9.0], False)], [("a", 2, [3.0], True)], [("a", 0, [4.0], False)]]
    live = run(spark, tmp_path, parts, make, chunks.Smoothing.columns, late="n_late")
    assert [(m, n) for _, _, m, _, n in sorted(live, key=lambda r: r[2])] == [(1.0, 0), (2.0, 1), (3.0, 2), (4.0, 0)]
    stored = spark.createDataFrame([("b", 0, [1.0], False), ("b", 0, [9.0], False), ("b", 1, [2.0], False)], CHUNK)
    assert [r["n_late"] for r in chunks.batched(stored, make, chunks.Smoothing.columns, late="n_late").orderBy("pos").collect()] == [0, 1]


def test_stored_streams_pass_through_in_small_batches(spark):
    """Streams longer than a batch, streams that end and begin again, and rows without a stream give the same as one by one."""
    rng = np.random.default_rng(7)
    rows = [(s, k, rng.random(3).tolist(), k % 17 == 16) for s in ("a", "b", None) for k in range(50)]
    frame = spark.createDataFrame(rows, CHUNK).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((tuple(r) for r in chunks.batched(frame, lambda: chunks.Smoothing(4, 0.5), chunks.Smoothing.columns).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for s in ("a", "b", None):
        p = chunks.Smoothing(4, 0.5)
        for _, k, x, eos in (r for r in rows if r[0] == s):
            want += [(s, *r) for r in p.push(np.array(x))]
            p = chunks.Smoothing(4, 0.5) if eos else p
    assert got == sorted(want, key=repr)
