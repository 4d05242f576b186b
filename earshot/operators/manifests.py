"""Manifests: lines of a key and values, joined into one row per utterance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.sources.store import stored


def parsed(lines: DataFrame, separator: str = " ") -> DataFrame:
    """(key, vals) from rows (line_no, value): the first item is the key, a later line replaces an earlier one of its key. Blank lines go."""
    # The shuffle carries the line's rest as it stands; items are made of the lines that stay.
    key = F.split(F.trim("value"), separator, 2)[0]
    rows = lines.filter(F.trim("value") != "").select("line_no", key.alias("key"), F.trim("value").substr(F.length(key) + 1, F.length("value")).alias("rest"))
    last = rows.groupBy("key").agg(F.max_by("rest", "line_no").alias("rest"))
    items = F.split("rest", separator)
    return last.select("key", F.slice(items, F.lit(2), F.size(items)).alias("vals"))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the one that comes last. One aggregation, with partial results before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(key, "row.*")


def flattened(vals: Column) -> Column:
    """The value of a list of one, else null."""
    return F.when(F.size(vals) == 1, vals[0])


def assembled(main: DataFrame, **others: DataFrame) -> DataFrame:
    """One row for each key of ``main`` (key, vals) with each other manifest's list and, for lists of one, its value; absent keys give nulls."""
    out = main.select("key", F.col("vals").alias("wav2scp"), flattened(F.col("vals")).alias("path"))
    for name, m in others.items():
        out = out.join(m.select("key", F.col("vals").alias(name), flattened(F.col("vals")).alias(f"{name}_value")), "key", "left")
    return out


def unmatched(main: DataFrame, **others: DataFrame) -> DataFrame:
    """(manifest, key): keys of other manifests that ``main`` lacks."""
    out = None
    for name, m in others.items():
        rows = m.join(main, "key", "left_anti").select(F.lit(name).alias("manifest"), "key")
        out = rows if out is None else out.unionByName(rows)
    return out


def targets(mixtures: DataFrame) -> DataFrame:
    """Two rows for each mixture (mixture_id, mixture_path, source_1, source_2): key, mixture, reference, its utterance and speaker, all speakers."""
    utts = F.split("mixture_id", "_")
    speaker = lambda u: F.split(u, "-")[0]
    both = F.concat_ws("-", speaker(utts[0]), speaker(utts[1]))
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"source_{i}").alias("ref"), utts[i - 1].alias("utt")) for i in (1, 2)))
    rows = mixtures.select("mixture_id", "mixture_path", both.alias("all_spks"), F.explode(sides).alias("s"))
    return rows.select(F.concat_ws("_", "mixture_id", F.col("s.side").cast("string")).alias("key"), F.col("mixture_path").alias("noisy"), "s.ref", "s.utt", speaker(F.col("s.utt")).alias("spk"), "all_spks")


def source_speaker(key: Column, all_spks: Column) -> Column:
    """The speaker of the source that a key's last character numbers, from 1 on."""
    side = F.substring(F.element_at(F.split(key, "_"), -1), -1, 1).cast("int")
    return F.element_at(F.split(all_spks, "-"), side)


def speakers(utts: DataFrame) -> DataFrame:
    """One row for each speaker of (line_no, uttid, spkid, gender, path, length, sample_rate, channels): gender, rate and channels of its first line, and its utterances."""
    return utts.groupBy("spkid").agg(
        *(F.min_by(c, "line_no").alias(c) for c in ("gender", "sample_rate", "channels")),
        F.count("*").alias("n_lines"),
        F.sort_array(F.collect_set(F.struct("uttid", "path", "length"))).alias("utts"),
    )


def indexed(rows: DataFrame, key: str | list[str], index: str = "idx") -> DataFrame:
    """``rows`` with their place in the order of ``key``, from 0 on; equal keys by a hash of the whole row.

    Rows are dealt out by ranges of the key; each range is numbered on its own and starts after the sizes of those
    before it, so no task sees all rows. The numbered ranges are stored once, so that rows and sizes agree.
    """
    order = [*([key] if isinstance(key, str) else key), "__tie"]
    ranges = rows.withColumn("__tie", F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(ranges.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("__tie"), "ranges")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    return parts.join(F.broadcast(starts), "__part").select(*(f"`{c}`" for c in rows.columns), (F.col("__start") + F.col("__at")).alias(index))


def numbered(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with ``number``, their place within their group in the order of ``key``, and the group's ``size``; a group of any size is spread over tasks."""
    placed = indexed(rows, [group, key], "__idx")
    groups = placed.groupBy(group).agg(F.min("__idx").alias("__first"), F.count("*").alias("size"))
    return placed.join(groups, group).withColumn("number", F.col("__idx") - F.col("__first")).drop("__idx", "__first")


def rows_by_speaker(rows: DataFrame) -> DataFrame:
    """(spk, rows): indices of each speaker's rows (idx, spk), in order."""
    return rows.groupBy("spk").agg(F.sort_array(F.collect_list("idx")).alias("rows"))


def speaker_labels(rows: DataFrame) -> DataFrame:
    """(spk, label): class ids of the distinct speakers in the order of their names as strings."""
    return indexed(rows.select(F.col("spk").cast("string").alias("spk")).distinct(), "spk", "label")
