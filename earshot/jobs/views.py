"""Speech-shaped views of the driver's tables: events stand for utterances and probabilities, embeddings for waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import scans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, spk, w)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("spk"), F.col("embedding").cast("array<double>").alias("w"))


def trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, spk, clean, noisy, enh): the next row's wave is the noise; every seventh row is made worse, not better."""
    w = waves(spark, sf_dir)
    size = w.agg(F.count("*").alias("size"))
    nxt = w.select(F.col("key").alias("next"), F.col("w").alias("noise"))
    rows = w.crossJoin(F.broadcast(size)).withColumn("next", (F.col("key") + 1) % F.col("size")).join(nxt, "next")
    mixed = lambda by: F.zip_with("w", "noise", lambda a, b: a + F.lit(by) * b)
    worse = F.col("key") % 7 == 0
    return rows.select("key", "spk", F.col("w").alias("clean"), F.when(worse, mixed(0.1)).otherwise(mixed(0.5)).alias("noisy"), F.when(worse, mixed(0.5)).otherwise(mixed(0.1)).alias("enh"))


TRIOS = """t AS (
  SELECT a.vec_id AS key, a.label AS spk, CAST(a.embedding AS DOUBLE[]) AS clean,
         [CAST(a.embedding[i] AS DOUBLE) + CASE WHEN a.vec_id % 7 = 0 THEN 0.1 ELSE 0.5 END::DOUBLE * CAST(b.embedding[i] AS DOUBLE) FOR i IN range(1, len(a.embedding) + 1)] AS noisy,
         [CAST(a.embedding[i] AS DOUBLE) + CASE WHEN a.vec_id % 7 = 0 THEN 0.5 ELSE 0.1 END::DOUBLE * CAST(b.embedding[i] AS DOUBLE) FOR i IN range(1, len(a.embedding) + 1)] AS enh
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, pos, p, label): a sequence of probabilities for each user, from its events in order; pos from 0 on."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL AND value IS NOT NULL")
    rows = e.select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("value") / (F.col("value") + 50.0)).alias("p"), (F.col("event_type") == "click").cast("int").alias("label"))
    return scans.numbered(rows, ["ts", "event_id"], "pos").select("key", "pos", "p", "label")


FRAMES = """f AS (
  SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / (value + 50.0::DOUBLE) AS p, (event_type = 'click')::INTEGER AS label
  FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"""


def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mixture_id, mixture_path, source_1, source_2): each event with the next one of another user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    utt = F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    a = e.select(F.col("event_id").alias("i"), F.col("user_id").alias("u1"), utt.alias("utt1"))
    b = e.select((F.col("event_id") - 1).alias("i"), F.col("user_id").alias("u2"), utt.alias("utt2"))
    path = lambda d, c: F.concat(F.lit(f"{d}/"), c, F.lit(".wav"))
    both = F.concat_ws("_", "utt1", "utt2")
    return a.join(b, "i").filter("u1 <> u2").select(both.alias("mixture_id"), path("mix", both).alias("mixture_path"), path("s1", F.col("utt1")).alias("source_1"), path("s2", F.col("utt2")).alias("source_2"))


MIXTURES = """m AS (
  SELECT a.user_id || '-' || a.event_id AS utt1, b.user_id || '-' || b.event_id AS utt2, a.user_id AS u1, b.user_id AS u2
  FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id)"""
