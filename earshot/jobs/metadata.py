"""Metadata preparation: mixture lists and corpus metadata to the manifests of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.manifests import targets
from earshot.operators.picks import enrolled
from earshot.sources.quarantine import parted, put_aside
from earshot.sources.text import checked_corpus, checked_mixtures, write_manifests

MANIFESTS = {"wav2scp": "noisy", "wav2ref": "ref", "ref2spk": "spk", "wav2spk": "all_spks", "ref2list": "enroll_paths"}


def prepared(mixed: DataFrame, utts: DataFrame, n_enroll: int = 5, seed: int = 0) -> DataFrame:
    """Target rows with the paths of their enrollment clips; ``short_pool`` marks those with too few, ``unknown`` those whose own utterance the corpus lacks."""
    corpus = utts.select("uttid", F.col("spkid").alias("spk"), "path")
    out = enrolled(targets(mixed), corpus, n_enroll, seed)
    paths = F.transform("enroll", lambda c: c["path"])
    return out.withColumns({"enroll_paths": F.filter(paths, lambda p: p.isNotNull()), "short_pool": F.size("enroll") < n_enroll, "unknown": ~F.col("known")}).drop("enroll", "known")


def prepare(spark: SparkSession, mixture_csv: str, corpus_csv: str, out: str, root: str | None = None, n_enroll: int = 5, seed: int = 0, strict: bool = False, compression: str | None = None) -> dict[str, dict[str, int]]:
    """Read, pick and write the five manifests; returns how many lines, mixtures and targets had which problem.

    Lines that are no metadata, mixtures without two utterances, targets with too few clips or an unknown utterance go
    to the quarantine below ``out``, or with ``strict`` are an error. The manifests are plain text unless a
    ``compression`` is named.
    """
    utts, broken, of_lines = checked_corpus(spark, corpus_csv, root)
    mixed, odd, of_mixtures = checked_mixtures(spark, mixture_csv)
    problems = {"unknown": F.col("unknown"), "short_pool": F.col("short_pool")}
    good, left, of_targets = parted(prepared(mixed, utts, n_enroll, seed), problems, "targets")
    counts = {"metadata": of_lines, "mixtures": of_mixtures, "targets": of_targets}
    if strict and (found := {f"{k}: {p}": n for k, c in counts.items() for p, n in c.items() if n and p != "rows"}):
        raise ValueError(f"bad rows: {found}")
    for bad, source in ((broken, "metadata"), (odd, "mixtures"), (left, "targets")):
        put_aside(bad, f"{out}/quarantine", source)
    write_manifests(good, out, MANIFESTS, compression=compression, keep=False)  # they are stored already
    return counts
