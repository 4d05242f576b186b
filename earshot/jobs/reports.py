"""Evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators.embeddings import centroids, silhouette
from earshot.operators.scores import confusion, summary, with_improvement
from earshot.operators.sequences import averaged_labels, stable_labels

SCORES = ["sisnr", "sisnri", "nsr", "nsr_neg"]


def enhancement_report(clean: DataFrame, enh: DataFrame, noisy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores by utterance and their means, from three tables (key, w) joined on the key."""
    rows = clean.select("key", F.col("w").alias("clean")).join(enh.select("key", F.col("w").alias("enh")), "key").join(noisy.select("key", F.col("w").alias("noisy")), "key")
    scores = with_improvement(rows).drop("clean", "enh", "noisy")
    return scores, summary(scores.filter("NOT unscored"), SCORES)


def activity_report(rows: DataFrame, threshold: float = 0.5, sample_rate: int = 16000, stability: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of voice activity (key, pos, p, label) by utterance and their means, after smoothing over runs (with ``stability``) or by moving average."""
    found = stable_labels(rows, threshold, stability, sample_rate) if stability is not None else averaged_labels(rows, threshold, sample_rate)
    scores = confusion(found.join(rows.select("key", "pos", "label"), ["key", "pos"]))
    return scores, summary(scores, ["accuracy", "precision", "recall", "f1"])


def embedding_report(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean silhouette and size by speaker, and each speaker's centroid."""
    return silhouette(rows).groupBy("spk").agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n")), centroids(rows)
