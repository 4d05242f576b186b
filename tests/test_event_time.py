from datetime import datetime, timedelta

import numpy as np

from earshot.streaming import chunks
from earshot.streaming import event_time as E

CHUNK = "stream_id string, seq long, ts timestamp, samples array<double>, eos boolean"
T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def deliver(spark, path, number, rows):
    spark.createDataFrame(rows, CHUNK).coalesce(1).write.parquet(f"{path}/in/{number:03d}")


def advance(spark, path, make, columns, idle=30):
    source = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    with E.rocksdb(spark):
        q = E.timed(source, make, columns, "10 seconds", idle).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()


def results(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(f"{path}/out").collect()), key=repr)


def parts():
    """Two streams; chunks of one delivery in disorder, some a delivery later, some again, some too late, one stream silent for long."""
    rng = np.random.default_rng(4)
    value = {(s, k): rng.random(3).round(6).tolist() for s in "ab" for k in range(60)}
    row = lambda s, k, t, eos=False: (s, k, at(t), value[s, k], eos)
    one = [row("a", k, 2 * k) for k in (3, 0, 2, 1)] + [row("b", 0, 1), row("b", 1, 3)]
    two = [row("a", 5, 10), row("a", 4, 8), row("a", 3, 6), row("b", 2, 9, True), row("a", 3, 6)]
    three = [row("a", 6, 42), row("a", 2, 4), row("b", 3, 41)]
    four = [row("a", 7, 75), row("b", 4, 90), row("a", 8, 20)]
    five = [(None, None, at(400), None, False)]
    return [one, two, three, four, five], value


def test_order_late_repeated_and_idle_by_event_time_whatever_the_restarts(spark, tmp_path):
    deliveries, value = parts()
    make, columns = lambda: chunks.Smoothing(4, 0.5), chunks.Smoothing.columns
    once, again = str(tmp_path / "once"), str(tmp_path / "again")
    for k, rows in enumerate(deliveries):
        deliver(spark, once, k, rows)
    advance(spark, once, make, columns)
    for k, rows in enumerate(deliveries):
        deliver(spark, again, k, rows)
        advance(spark, again, make, columns)
    got = results(spark, once)
    assert got == results(spark, again)
    # By hand: the watermark is 10 s behind the latest time of the deliveries before.
    assert sorted((r[0], r[2], r[3]) for r in got if r[3] in ("late", "repeated")) == [("a", 2, "repeated"), ("a", 3, "repeated"), ("a", 3, "repeated"), ("a", 8, "late")]
    assert sorted((r[0], r[1], r[2]) for r in got if r[3] == "closed") == [("a", T0, 5), ("a", at(42), 6), ("a", at(75), 7), ("b", at(1), 2), ("b", at(41), 3), ("b", at(90), 4)]
    whole = np.concatenate([value["a", k] for k in range(6)])
    want = [np.r_[np.zeros(3), whole][i : i + 4].sum() / 4 for i in range(len(whole))]
    mine = sorted((r[4], r[5]) for r in got if r[0] == "a" and r[1] == T0 and r[3] is None)
    assert np.allclose([m for _, m in mine], want) and [p for p, _ in mine] == list(range(18))
    # What was accepted, stored and run as a batch, gives the same results and ends.
    refused = {("a", 8)}
    kept = {(r[0], r[1]): r for rows in deliveries for r in rows if r[0] and (r[0], r[1]) not in refused}
    batch = E.settled(spark.createDataFrame(list(kept.values()), CHUNK), make, columns, 30)
    assert sorted((tuple(r) for r in batch.collect()), key=repr) == [r for r in got if r[3] in (None, "closed")]


def test_state_is_dropped_when_streams_end(spark, tmp_path):
    deliveries, _ = parts()
    path = str(tmp_path)
    for k, rows in enumerate([*deliveries, [(None, None, at(900), None, False)]]):
        deliver(spark, path, k, rows)
    make = lambda: chunks.Folded(lambda: np.zeros(2), lambda s, x: s + [len(x), x.sum()], lambda s: s)
    advance(spark, path, make, chunks.Folded.columns)
    rows = results(spark, path)
    assert [(r[0], r[2], r[4]) for r in rows if r[4] is not None] == [("a", 5, 18), ("a", 6, 3), ("a", 7, 3), ("b", 2, 9), ("b", 3, 3), ("b", 4, 3)]
    for name in ("flow", "waiting"):
        state = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", name)
        assert state.load().count() == 0


def test_settled_without_rows(spark):
    empty = spark.createDataFrame([], CHUNK)
    assert E.settled(empty, lambda: chunks.Smoothing(2, 0.1), chunks.Smoothing.columns, 5).count() == 0
    beat = spark.createDataFrame([(None, None, at(0), None, False), ("a", 0, at(1), None, False)], CHUNK)
    assert [r["fate"] for r in E.settled(beat, lambda: chunks.Smoothing(2, 0.1), chunks.Smoothing.columns, 5).collect()] == ["closed"]


def test_final_waves_by_an_idempotent_sink(spark, tmp_path):
    """Frames of two streams put together again; each stream's file is there once it has ended, and a batch that runs again changes nothing."""
    from earshot.sources.audio import wave_sink, waves

    path, rng = str(tmp_path), np.random.default_rng(6)
    frames = {s: [rng.uniform(-0.5, 0.5, 4).astype(np.float32).tolist() for _ in range(6)] for s in "ab"}
    row = lambda s, k, t, eos=False: (s, k, at(t), frames[s][k], eos)
    deliver(spark, path, 0, [row("a", k, k) for k in range(4)] + [row("b", k, k) for k in range(3)])
    deliver(spark, path, 1, [row("a", 4, 5), row("a", 5, 20, True), row("b", 3, 60)])
    deliver(spark, path, 2, [(None, None, at(500), None, False)])
    make = lambda: chunks.OverlapAdd(4, 2)
    source = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    sink, seen = wave_sink(f"{path}/out", 8000), []

    def twice(batch, number):
        seen.append(number)
        for _ in range(2):
            sink(batch, number)

    with E.rocksdb(spark):
        E.timed(source, make, chunks.OverlapAdd.columns, "10 seconds", 30).writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r["uttid"]: (r["sample_rate"], r["w"]) for r in waves(spark, f"{path}/out/waves").collect()}
    want = {}
    for s, parts in (("a", [range(6)]), ("b", [range(3), range(3, 4)])):
        for part in parts:
            add = make()
            samples = [v for k in part for _, w in add.push(np.array(frames[s][k])) for v in w] + [v for _, w in add.finish() for v in w]
            began = {("a", 0): 0, ("b", 0): 0, ("b", 3): 60}[s, part[0]]
            want[f"{s}_{int(at(began).timestamp() * 1e6) + int(_offset())}"] = samples
    assert set(got) == set(want) and len(seen) >= 3
    for name, w in want.items():
        assert got[name][0] == 8000 and np.allclose(got[name][1], w, atol=1e-6)


def _offset():
    """Microseconds between this machine's clock and UTC."""
    from datetime import timezone

    return (T0.replace(tzinfo=timezone.utc).timestamp() - T0.timestamp()) * 1e6


def test_streams_that_share_keys_of_state_give_the_same(spark, tmp_path):
    """Thirty streams in three buckets: as with a key for each, at every delivery, and the store holds no more than three."""
    rng = np.random.default_rng(8)
    rows = [[(f"s{k}", j, at(40 * d + int(t)), None if j % 7 == 0 else [float(j), k / 7], j % 11 == 10) for k in range(30) for j, t in enumerate(rng.integers(0, 55, 6), 6 * d)] for d in range(4)]
    deliveries = [rows[0], rows[1] + rows[0][::5], rows[2] + rows[2][::4], rows[3] + rows[0][::9], [(None, None, at(900), None, False)]]
    make, columns, found = lambda: chunks.Smoothing(3, 0.5), chunks.Smoothing.columns, {}
    for buckets in (None, 3):
        path = str(tmp_path / f"{buckets}")
        for d, given in enumerate(deliveries):
            deliver(spark, path, d, given)
            source = spark.readStream.schema(CHUNK).parquet(f"{path}/in/*")
            with E.rocksdb(spark, partitions=2):
                E.timed(source, make, columns, "10 seconds", 12, buckets).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
            if d == 2 and buckets:
                for name in ("flow", "waiting"):
                    state = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", name).load()
                    assert 0 < state.select("key").distinct().count() <= buckets and state.select("partition_id").distinct().count() <= 2
        found[buckets] = results(spark, path)
    assert found[3] == found[None]
    assert {r[3] for r in found[3]} == {None, "late", "repeated", "closed"}


def test_packed_rows_of_state_are_bounded():
    """A long chunk is a row of its own, short ones share one."""
    long, short = ("a", 0, 0, bytes(8 * E.PACK), False), ("a", 0, 0, bytes(8), False)
    assert [len(E._unpacked([p])) for p in E._packed([long, long, *[short] * 10_000], E._chunk_size)] == [1, 1, 1639, 1639, 1639, 1639, 1639, 1639, 166]
    assert E._packed([], E._chunk_size) == [] and E._unpacked([]) == []
