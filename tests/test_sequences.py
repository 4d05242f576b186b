import itertools
import random

from pyspark.sql import functions as F

from earshot.jobs import views
from earshot.operators import scans, sequences


def frame(spark, seqs):
    return spark.createDataFrame([(k, i, float(p)) for k, s in seqs.items() for i, p in enumerate(s)], "key string, pos long, p double")


def listed(df, column="value"):
    out = {}
    for r in df.orderBy("key", "pos").collect():
        out.setdefault(r["key"], []).append(r[column])
    return out


def by_hand(bits, least):
    """Smoothing of one sequence, step by step."""
    found = [(v, len(list(g))) for v, g in itertools.groupby(bits)]
    if len(found) == 1:
        return list(bits)
    out, i = [], 0
    while i < len(found):
        if found[i][1] >= least:
            out += [found[i][0]] * found[i][1]
            i += 1
            continue
        j = i
        while j < len(found) and found[j][1] < least:
            j += 1
        n, ones = sum(x for _, x in found[i:j]), sum(x for v, x in found[i:j] if v)
        out += [(out[-1] if out else 0) if n < least else int(2 * ones > n)] * n
        i = j
    return out


def test_documented_example(spark):
    p = [0.1, 0.6, 0.2, 0.6, 0.1, 0.1, 0.1, 0.7, 0.7, 0.7, 0.7, 0.7, 0.7, 0.1]
    assert listed(sequences.stable_labels(frame(spark, {"a": p}), 0.5, 3, 1)) == {"a": [0] * 7 + [1] * 7}
    r = sequences.runs(spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 0, 1, 0])], "key string, pos long, value int"))
    assert [(x["value"], x["n"]) for x in r.orderBy("run").collect()] == [(0, 2), (1, 1), (0, 1)]


def test_smoothing_against_steps(spark):
    rng = random.Random(1)
    seqs = {f"{n:03d}": [rng.choice([0.0, 1.0]) if rng.random() < 0.5 else 1.0 for _ in range(rng.randint(1, 30))] for n in range(80)}
    seqs["long"], seqs["one"] = [1.0] * 2, [0.0]
    for least in (1, 3, 5):
        assert listed(sequences.stable_labels(frame(spark, seqs), 0.5, least, 1)) == {k: by_hand([int(x) for x in s], least) for k, s in seqs.items()}


def test_moving_average_pads_with_zeros(spark):
    got = listed(sequences.moving_average(frame(spark, {"a": [4, 8, 4]}), 4), "mean")
    assert got == {"a": [1.0, 3.0, 4.0]}
    assert listed(sequences.moving_average(frame(spark, {"a": [3, 6, 9]}), 3, causal=False), "mean") == {"a": [3.0, 6.0, 5.0]}


def test_segments_round_trip(spark):
    for n in (1, 3, 4, 8, 9, 40):
        x = [float(i + 1) for i in range(n)]
        parts = sequences.segments(frame(spark, {"a": x}), 8)
        assert listed(sequences.merged_segments(parts)) == {"a": x}
        assert parts.filter("pos IS NOT NULL").groupBy("pos").count().filter("count <> 2").count() == 0


def test_rasterized_spans(spark):
    grid = spark.range(10).select(F.lit("a").alias("key"), F.col("id").alias("pos"))
    spans = spark.createDataFrame([("a", 2, 4), ("a", 3, 6), ("a", 5, 5), ("a", 8, 99), ("b", 0, 9)], "key string, start long, stop long")
    assert listed(sequences.rasterized(grid, spans), "label") == {"a": [0, 0, 1, 1, 1, 1, 0, 0, 1, 1]}
    assert listed(sequences.rasterized(grid, spans.limit(0)), "label") == {"a": [0] * 10}


def test_blocks_of_any_size_give_the_same(spark):
    rng = random.Random(3)
    seqs = {f"k{n}": [rng.choice([0.0, 0.4, 1.0]) if rng.random() < 0.6 else 1.0 for _ in range(rng.randint(1, 40))] for n in range(25)} | {"one": [1.0]}
    rows = frame(spark, seqs)
    binary = rows.select("key", "pos", (F.col("p") > 0.5).cast("int").alias("value"))
    spans = spark.createDataFrame([(k, *sorted((rng.randint(0, 40), rng.randint(0, 45)))) for k in seqs for _ in range(3)], "key string, start long, stop long")
    for block in (1, 3, 8):
        smooth = sequences.expanded(sequences.smoothed_runs(sequences.runs(binary, block=block), 3, block))
        assert listed(smooth) == {k: by_hand([int(x > 0.5) for x in s], 3) for k, s in seqs.items()}
        for kernel, causal in ((1, True), (4, True), (5, False), (4, False)):
            behind = kernel - 1 if causal else kernel // 2
            want = {k: [sum(s[max(i - behind, 0) : i - behind + kernel]) / kernel for i in range(len(s))] for k, s in seqs.items()}
            got = listed(sequences.moving_average(rows, kernel, causal=causal, block=block), "mean")
            assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k], strict=True))
        open_ = {(k, i) for k, a, b in spans.collect() for i in range(a, b)}
        assert listed(sequences.rasterized(rows, spans, block), "label") == {k: [int((k, i) in open_) for i in range(len(s))] for k, s in seqs.items()}
    assert listed(sequences.moving_average(rows, 4, stride=3, block=5), "mean")["k1"] == listed(sequences.moving_average(rows, 4), "mean")["k1"][::3]


def test_gaps_and_nulls_in_one_long_key(spark, monkeypatch):
    """One key with places far apart: no block, and so no task, holds more rows than asked for."""
    seen = []
    store = scans.stored
    monkeypatch.setattr(scans, "stored", lambda df, name: seen.append(store(df, name)) or seen[-1])
    n, block = 30_000, 500
    rows = spark.range(n).select(F.lit(None).cast("string").alias("key"), (F.col("id") * 7).alias("pos"), (F.col("id") % 10 < 6).cast("double").alias("p"), F.when(F.col("id") % 100 != 50, (F.floor(F.col("id") / 20) % 3)).alias("value"))
    want = [None if i % 100 == 50 else i // 20 % 3 for i in range(n)]
    starts = [i for i in range(n) if i == 0 or None not in (want[i], want[i - 1]) and want[i] != want[i - 1]]
    got = sequences.runs(rows, block=block).orderBy("run").collect()
    assert [(r["start"] // 7, r["run"]) for r in got] == [(s, k) for k, s in enumerate(starts)] and sum(r["n"] for r in got) == n
    means = sequences.moving_average(rows, 10, block=block)
    assert means.count() == n and means.filter("pos >= 63").select(F.min("mean"), F.max("mean")).first() == (0.6, 0.6)
    assert max(df.groupBy("key", "__block").count().agg(F.max("count")).first()[0] for df in seen) <= block


def test_scanned_blocks_are_never_broadcast(spark):
    """Their files are far smaller than their rows, so that by size all rows would go to one task."""
    found = sequences.runs(frame(spark, {"a": [0, 1, 1, 0], "b": [1]}).select("key", "pos", "p"), "p")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.count() == 4


def test_no_step_of_stable_labels_broadcasts(spark, monkeypatch):
    """Neither what is stored on the way nor the labels: each level is rows of all keys, however small its file."""
    plans, store = [], scans.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(scans, "stored", lambda df, name: plans.append(plan(df)) or store(df, name))
    found = sequences.stable_labels(frame(spark, {"a": [0, 1, 1, 1, 0], "b": [1]}), 0.5, 3, 1)
    plans.append(plan(found))
    assert len(plans) == 4 and sum(p.count("SortMergeJoin") for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert listed(found) == {"a": [0, 1, 1, 1, 1], "b": [1]}


def test_numbers_within_keys_cut_into_parts(spark):
    """Keys of any length, null keys and nulls in the order (last, as in SQL), places that repeat, whatever the size of the parts."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 2, 3]), None if n % 50 == 0 else n % 290) for n in range(600)] + [("one", None, None)]
    df = spark.createDataFrame(rows, "key string, at int, id int")
    last = lambda x: (x is None, x or 0)
    want = sorted(((k, a, i) for k, a, i in rows), key=lambda r: (last(r[1]), last(r[2])))
    for one_in, most in ((1, 1000), (1, 3), (7, 64), (10**9, 64)):
        got = scans.numbered(df, ["at", "id"], "pos", one_in, most).collect()
        assert len(got) == len(rows)
        for key in ("a", "b", None, "one"):
            mine = sorted((r for r in got if r["key"] == key), key=lambda r: r["pos"])
            assert [r["pos"] for r in mine] == list(range(len(mine)))
            assert [(r["at"], r["id"]) for r in mine] == [r[1:] for r in want if r[0] == key]


def test_frames_of_one_user_spread_over_tasks(spark, tmp_path):
    n = 32 * scans.CUT
    e = spark.range(n).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        held = views.frames(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.sum("pos").alias("total")).collect()
    finally:
        spark.conf.unset(merging)
    assert sum(r["rows"] for r in held) == n and sum(r["total"] for r in held) == n * (n - 1) // 2
    assert max(r["rows"] for r in held) < 0.8 * n


def test_events_without_a_time_come_last_as_in_sql(spark, duck, tmp_path):
    e = spark.createDataFrame([(1, None, 1, "click", 9.0), (2, "2024-01-02", 1, "view", 90.0), (None, "2024-01-01", 1, "view", 7.0), (3, "2024-01-01", 1, "view", 8.0)], "event_id long, ts string, user_id long, event_type string, value double")
    e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    want = duck.execute(f"WITH {views.FRAMES.replace('FROM events', f'''FROM read_parquet('{tmp_path}/events.parquet/*.parquet')''')} SELECT key, pos, p, label FROM f ORDER BY pos").fetchall()
    assert [tuple(r) for r in views.frames(spark, str(tmp_path)).orderBy("pos").collect()] == want
