import hashlib
import random

import pytest
from pyspark.sql import functions as F

from earshot.llm import warc as W
from earshot.sources.store import shared_folder


def round_trip(spark, df):
    path = f"{shared_folder(spark)}/warc"
    W.write_archives(df, path)
    return W.merged_index(W.read_archives(spark, path)), path


def test_round_trip(spark):
    long = "<p>" + "long page é \r\n\r\nWARC/1.1\r\n" * 20
    rows = [(i, f"http://www.a{i % 3}.example.com/p?q={i}", long if i % 4 == 0 else f"page {i} " * 30) for i in range(40)]
    rows += [(100, None, None), (101, "u v\r\nX: y", ""), (102, "http://b.org", "x" * 99), (103, "http://b.org", "x" * 99), (104, "http://b.org", "x" * 100), (105, "http://b.org", "x" * 100), (105, "http://b.org", "x" * 100), (None, "http://n.org", "x" * 100), (None, "http://n.org", "y" * 200), (106, "http://big.org", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("first", F.lit(2)).repartition(3)
    got, path = round_trip(spark, df)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [k for k, _, x in rows if k is not None and (x or "") == (h or "")]
        first = min(same, default=None)
        response = len(data) < 100 or first is None or first == i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if response else "revisit", None if response else first))
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == sorted(want, key=str)
    files = spark.read.format("binaryFile").load(path + "/*.gz").collect()
    assert len(files) >= 3
    # A file is a sorted run, and the merged partitions hold the whole index in order.
    for name in {r["run"] for r in W.read_archives(spark, path).select("run").collect()}:
        run = W.read_archives(spark, path).filter(F.col("run") == name).orderBy("offset").collect()
        keys = [(r["url_key"], r["captured"]) for r in run]
        assert keys == sorted(keys)
    key = lambda r: (r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0)
    ordered = [key(r) for r in got.collect()]
    assert ordered == sorted(ordered) and len(ordered) == len(rows)


def test_empty_and_damaged(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{shared_folder(spark)}/warc"
    W.write_archives(df, path)
    with pytest.raises(ValueError):
        list(W.records(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))
    with pytest.raises(ValueError):
        list(W.records(b"nothing"))
    assert W.read_archives(spark, path).count() == 0


def test_url_keys(spark):
    df = spark.createDataFrame([("HTTPS://www.Blog.Example.com/A?b=C#d",), ("x.org",), (None,)], "u string")
    assert [r[0] for r in df.select(W.url_key(F.col("u"))).collect()] == ["com,example,blog)/a?b=c", "org,x)", ")"]


def test_loser_tree():
    rng = random.Random(0)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9), i, j) for j in range(rng.randint(0, 6))) for i in range(rng.randint(0, 9))]
        assert [h for _, h in W.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_dates_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got, _ = round_trip(spark, spark.createDataFrame([(5, "u", "h")], "page_id long, url string, html string"))
        assert got.first()["captured"] == "1970-01-01T00:00:05Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
