import pytest
from pyspark.sql import functions as F

from earshot.functions import flags
from earshot.jobs.metadata import prepare, prepared
from earshot.operators import manifests, picks
from earshot.sources import text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lines_last_wins_and_blanks(spark, tmp_path):
    (tmp_path / "wav2scp.txt").write_text("aaa /p/a.wav\n\n bbb /p/b.wav \naaa /p/c.wav x\n")
    m = text.manifest(spark, str(tmp_path / "wav2scp.txt"))
    assert rows(m) == [("aaa", ["/p/c.wav", "x"]), ("bbb", ["/p/b.wav"])]


def test_folder_assembly_and_unmatched(spark, tmp_path):
    (tmp_path / "wav2scp.txt").write_text("k1 a.wav\nk2 b.wav\n")
    (tmp_path / "wav2ref.txt").write_text("k1 r1.wav\nk9 r9.wav\n")
    got, lost = text.folder(spark, str(tmp_path), "ns")
    assert rows(got.select("key", "path", "wav2ref_value")) == [("k1", "a.wav", "r1.wav"), ("k2", "b.wav", None)]
    assert rows(lost) == [("wav2ref", "k9")]
    with pytest.raises(Exception):
        text.folder(spark, str(tmp_path), "dss")


def test_flags(spark):
    df = spark.createDataFrame([("TRUE", " a  b c ", "0.5,2")], "f string, l string, s string")
    got = df.select(flags.is_true(F.col("f")), flags.listed(F.col("l")), flags.span(F.col("s"))).first()
    assert tuple(got) == (True, ["a", "b", "c"], (0.5, 2.0))
    assert not spark.createDataFrame([("1",)], "f string").select(flags.is_true(F.col("f"))).first()[0]


CORPUS = "uttid, spkid, gender, path, length, sample_rate, channels\n" + "".join(f"{s}-1-{u:04d}, {s}, {'MF'[s % 2]}, {s}/{u}.flac, {1000 + u}, 16000, 1\n" for s in (10, 9, 11) for u in range(8))


def test_metadata_preparation(spark, tmp_path):
    (tmp_path / "corpus.csv").write_text(CORPUS)
    (tmp_path / "mix.csv").write_text("mixture_ID,mixture_path,source_1_path,source_2_path,length\n10-1-0000_9-1-0003,m/a.wav,s1/a.wav,s2/a.wav,5\n11-1-0001_77-1-0001,m/b.wav,s1/b.wav,s2/b.wav,5\n")
    mixed, utts = text.mixtures(spark, str(tmp_path / "mix.csv")), text.corpus(spark, str(tmp_path / "corpus.csv"), "/root")
    got = {r["key"]: r for r in prepared(mixed, utts).collect()}
    assert set(got) == {"10-1-0000_9-1-0003_1", "10-1-0000_9-1-0003_2", "11-1-0001_77-1-0001_1", "11-1-0001_77-1-0001_2"}
    r = got["10-1-0000_9-1-0003_2"]
    assert (r["spk"], r["all_spks"], r["ref"], r["short_pool"], r["unknown"]) == ("9", "10-9", "s2/a.wav", False, False)
    assert len(set(r["enroll_paths"])) == 5 and all(p.startswith("/root/9/") and not p.endswith("/3.flac") for p in r["enroll_paths"])
    assert got["11-1-0001_77-1-0001_2"]["unknown"] and got["11-1-0001_77-1-0001_2"]["short_pool"]
    prepare(spark, str(tmp_path / "mix.csv"), str(tmp_path / "corpus.csv"), str(tmp_path / "out"))
    assert rows(text.manifest(spark, str(tmp_path / "out/wav2spk.txt")))[0] == ("10-1-0000_9-1-0003_1", ["10-9"])
    assert len(rows(text.manifest(spark, str(tmp_path / "out/ref2list.txt")))[0][1]) == 5
    with pytest.raises(ValueError):
        prepare(spark, str(tmp_path / "mix.csv"), str(tmp_path / "corpus.csv"), str(tmp_path / "out2"), strict=True)
    assert manifests.speakers(utts).filter("spkid = '9'").select("gender", "n_lines").first() == ("F", 8)


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"), F.col("id").alias("idx"), (F.col("id") % 7).cast("string").alias("spk"), (F.col("id") % 7).cast("string").alias("all_spks"))
    one, seven = picks.interferers(df.repartition(1)), picks.interferers(df.repartition(7))
    assert rows(one) == rows(seven)
    assert all(r["other_spk"] != r["spk"] for r in one.collect())
    assert rows(picks.shuffled(df, 16).select("key", "batch", "pos")) == rows(picks.shuffled(df.repartition(5), 16).select("key", "batch", "pos"))
    assert sorted(r["idx2"] for r in manifests.indexed(df, "key", "idx2").collect()) == list(range(500))


def test_interferer_of_everyone_is_null(spark):
    df = spark.createDataFrame([("a", 0, "1", "1-2"), ("b", 1, "2", "1-2")], "key string, idx long, spk string, all_spks string")
    assert [r["other_idx"] for r in picks.interferers(df).collect()] == [None, None]
    three = df.union(spark.createDataFrame([("c", 2, "3", "3")], df.schema))
    assert {r["key"]: r["other_spk"] for r in picks.interferers(three, tries=1).collect()}.items() >= {"a": "3", "b": "3"}.items()


def test_bad_rows_are_counted_and_kept_aside(spark, tmp_path):
    lines = ["uttid, spkid, gender, path, length, sample_rate, channels"] + [f"1-{k}, 1, F, 1-{k}.flac, 100, 16000, 1" for k in range(8)] + [f"2-{k}, 2, M, 2-{k}.flac, 100, 16000, 1" for k in range(3)]
    lines += ["2-x, 2, M, 2-x.flac", "2-y, 2, M, 2-y.flac, long, 16000, 1", ", 2, M, p.flac, 100, 16000, 1", "2-z, 2, M, , 100, 16000, 1", "2-w, 2, M, w.flac, 0, 16000, 1", "2-v, 2, M, v.flac, 5, , 1"]
    (tmp_path / "corpus.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "mix.csv").write_text("mixture_ID,mixture_path,source_1_path,source_2_path\n1-0_2-0,m.wav,a.wav,b.wav\n1-1_9-9,m2.wav,a.wav,b.wav\nodd,m3.wav,a.wav,b.wav\n1-2_1-3,,a.wav,b.wav\n")
    counts = prepare(spark, str(tmp_path / "mix.csv"), str(tmp_path / "corpus.csv"), str(tmp_path / "out"))
    assert counts == {
        "metadata": {"rows": 17, "malformed": 2, "no_id": 1, "no_path": 1, "no_length": 1, "no_rate": 1},
        "mixtures": {"rows": 4, "bad_id": 1, "no_path": 1},
        "targets": {"rows": 4, "unknown": 1, "short_pool": 1},
    }
    aside = spark.read.parquet(str(tmp_path / "out/quarantine"))
    assert {(r["source"], r["problem"]): r["count"] for r in aside.groupBy("source", "problem").count().collect()} == {(s, p): n for s, c in counts.items() for p, n in c.items() if p != "rows"}
    assert "2-y, 2, M, 2-y.flac, long, 16000, 1" in aside.filter("problem = 'malformed' AND row LIKE '%2-y%'").first()["row"]
    assert spark.read.text(str(tmp_path / "out/wav2scp.txt")).count() == 2


def test_enrollments_meet_their_speaker_once(spark):
    """Speakers within one row and larger ones draw alike; a target is neither taken apart into its draws nor shuffled twice."""
    utts = spark.createDataFrame([(f"{s}-{u:02d}", str(s)) for s in range(6) for u in range(s * 3 + 1)], "uttid string, spk string")
    targets = spark.createDataFrame([(f"{s}/{u}", f"{s}-{u:02d}", str(s)) for s in range(7) for u in range(s * 3 + 2)] + [("2/0", "2-00", "2")], "key string, utt string, spk string")
    whole = picks.enrollments(targets, utts)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2
    got = {tuple(r) for r in picks.enrolled(targets.distinct(), utts, held=7).select("key", "spk", "enroll.uttid", "known").collect() for r in [(r["key"], r["spk"], tuple(r["uttid"]), r["known"])]}
    want = {(r["key"], r["spk"], tuple(r["enroll"])) for r in whole.collect()}
    assert {g[:3] for g in got} == want and len(want) == targets.count() - 1
    for key, spk, enroll, known in got:
        s, u = map(int, key.split("/"))
        size = s * 3 + 1 if s < 6 else 0
        assert known == (u < size) and len(enroll) == len(set(enroll)) == min(5, size - known) and f"{s}-{u:02d}" not in enroll


def test_a_mixture_listed_twice_keeps_lists_of_five(spark):
    mixed = spark.createDataFrame([("10-1-0000_9-1-0003", "m.wav", "a.wav", "b.wav")] * 2, "mixture_id string, mixture_path string, source_1 string, source_2 string")
    utts = spark.createDataFrame([(f"{s}-1-{u:04d}", str(s), f"{s}/{u}.flac") for s in (10, 9) for u in range(8)], "uttid string, spkid string, path string")
    made = prepared(mixed, utts)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert len(got) == 4 and all(len(set(r["enroll_paths"])) == len(r["enroll_paths"]) == 5 and not r["short_pool"] and not r["unknown"] for r in got)
