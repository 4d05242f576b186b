"""Label sequences: runs, smoothing, moving averages, segments. Rows are (key, pos, ...) in order of pos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators import scans


def runs(rows: DataFrame, value: str = "value", block: int = scans.BLOCK) -> DataFrame:
    """(key, run, value, start, n): stretches of equal values; a null begins none. A key of any length is spread over tasks."""
    other = lambda before, own: F.coalesce(own[value] != before[value], F.lit(False))
    numbered = scans.stretches(rows.select("key", "pos", value), "pos", [value], other, "run", block)
    return numbered.groupBy("key", "run").agg(F.min_by(value, "pos").alias("value"), F.min("pos").alias("start"), F.count("*").alias("n"))


def smoothed_runs(found: DataFrame, least: int, block: int = scans.BLOCK) -> DataFrame:
    """Runs after smoothing, (key, start, n, value): runs of ``least`` places stay; of a stretch of shorter ones that is itself shorter,
    the value is that of the long run before it (0 if none), otherwise the majority of its places (0 on a tie). A sequence of one run stays."""
    apart = lambda before, own: (own["n"] >= least) | (before["n"] >= least)
    grouped = scans.stretches(found, "run", ["n"], apart, "grp", block)
    ones = F.sum(F.when(F.col("value") == 1, F.col("n")).otherwise(0))
    merged = grouped.groupBy("key", "grp").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.min_by("value", "run").alias("value"), F.min("start").alias("start"), F.sum("n").alias("n"), ones.alias("ones"))
    # Short stretches are as long as can be, so what stands before one is a long run.
    placed = scans.carried(merged, "grp", lags={"before": F.col("value")}, totals={"all": F.col("runs")}, size=block)
    short = F.when(F.col("n") < least, F.coalesce("before", F.lit(0))).otherwise((2 * F.col("ones") > F.col("n")).cast("int"))
    stays = (F.col("longest") >= least) | (F.col("all") == 1)
    return placed.select("key", "start", "n", F.when(stays, F.col("value")).otherwise(short).cast("int").alias("value"))


def expanded(found: DataFrame) -> DataFrame:
    """(key, pos, value) for every place of runs (key, start, n, value)."""
    return found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos"), "value")


def stable_labels(rows: DataFrame, threshold: float, stability: float, sample_rate: int, p: str = "p") -> DataFrame:
    """(key, pos, value): 1 where p is above the threshold, smoothed over runs shorter than ``stability`` seconds."""
    binary = rows.select("key", "pos", (F.col(p) > threshold).cast("int").alias("value"))
    return expanded(smoothed_runs(runs(binary), int(stability * sample_rate)))


def moving_average(rows: DataFrame, kernel: int, stride: int = 1, causal: bool = True, p: str = "p", block: int = scans.BLOCK) -> DataFrame:
    """(key, pos, mean): mean of the last ``kernel`` places, or of those around, where places outside count as zeros. Every ``stride``-th place from the first on."""
    behind = kernel - 1 if causal else kernel // 2
    mean = lambda w: F.sum(p).over(w) / F.lit(kernel)
    out = scans.sliding(rows.select("key", "pos", p), "pos", behind, kernel - 1 - behind, {"mean": mean}, block).select("key", "pos", "mean")
    if stride == 1:
        return out
    first = rows.groupBy("key").agg(F.min("pos").alias("__first"))
    return out.join(first, "key").filter((F.col("pos") - F.col("__first")) % stride == 0).drop("__first")


def averaged_labels(rows: DataFrame, threshold: float, sample_rate: int, p: str = "p") -> DataFrame:
    """(key, pos, value): 1 where the causal mean over 200 ms is above the threshold."""
    return moving_average(rows, int(0.2 * sample_rate), p=p).select("key", "pos", (F.col("mean") > threshold).cast("int").alias("value"))


def segments(rows: DataFrame, size: int, p: str = "p") -> DataFrame:
    """(key, segment, at, pos, value): half-overlapping segments of an even ``size``.

    The sequence gets zeros on the right so that segments come out even (a whole segment of them if it did already)
    and half a segment of zeros at both ends; pos is null for zeros, so every pos lies in two segments.
    """
    half = size // 2
    n = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rest = size - (half + F.col("n") % size) % size
    counts = n.withColumn("segments", ((F.col("n") + rest + 2 * half) / half - 1).cast("int"))
    grid = counts.select("key", "first", "n", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("at"))
    placed = grid.withColumn("pos", F.col("segment") * half + F.col("at") - half)
    placed = placed.withColumn("pos", F.when((F.col("pos") >= 0) & (F.col("pos") < F.col("n")), F.col("pos") + F.col("first")))
    values = rows.select("key", "pos", F.col(p).alias("value"))
    return placed.join(values, ["key", "pos"], "left").select("key", "segment", "at", "pos", F.coalesce("value", F.lit(0.0)).alias("value"))


def merged_segments(parts: DataFrame) -> DataFrame:
    """(key, pos, value): the mean of both segments that hold a place."""
    return parts.filter("pos IS NOT NULL").groupBy("key", "pos").agg(F.avg("value").alias("value"))


def rasterized(grid: DataFrame, spans: DataFrame, block: int = scans.BLOCK) -> DataFrame:
    """(key, pos, label): 1 where a span [start, stop) of the key holds the place.

    Spans mark where they begin and end; a running sum over the marks says how many are open. Linear in places and
    spans however they overlap, without a join of every place with every span, and over keys of any length.
    """
    whole = spans.filter("start < stop")
    marks = whole.select("key", F.col("start").alias("pos"), F.lit(1).alias("change")).unionByName(whole.select("key", F.col("stop").alias("pos"), F.lit(-1).alias("change"))).groupBy("key", "pos").agg(F.sum("change").alias("change"))
    rows = grid.select("key", "pos", F.lit(0).alias("change"), F.lit(True).alias("place")).unionByName(marks.select("key", "pos", "change", F.lit(False).alias("place")))
    counted = scans.carried(rows, "pos", sums={"open": F.col("change")}, size=block)
    return counted.filter("place").select("key", "pos", (F.col("open") > 0).cast("int").alias("label"))
