"""Training sets: manifests, waveforms, plans and batches put together. Waveforms join after all draws, by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import waves
from earshot.functions.draws import whole
from earshot.functions.signal import resampled
from earshot.jobs.augment import ENROLLMENT, TSE, Chances, augmented, enrollment_level, paired_offset, plan, replayed
from earshot.operators.picks import assigned, by_length, cases, drawn_until, interferers


def _cut(rows: DataFrame, columns: list[str], ref: str, n: int | None, seed: int, heard: bool = True) -> DataFrame:
    """Cut the columns at one offset, where the reference is heard or (not ``heard``) anywhere."""
    if n is None:
        return rows
    at = rows.withColumn("offset", paired_offset(F.col(ref), n, F.col("key"), 8 if heard else 0, seed))
    return at.withColumns({c: waves.cut(F.col(c), F.col("offset"), n) for c in columns})


def _at_rate(rows: DataFrame, columns: list[str], sample_rate: int) -> DataFrame:
    """Waveforms at the job's rate; tables without a column ``sample_rate`` have it already."""
    return resampled(rows, sample_rate, columns) if "sample_rate" in rows.columns else rows


def _with_clips(rows: DataFrame, noises: DataFrame | None, rirs: DataFrame | None, sample_rate: int, seed: int) -> DataFrame:
    """Noise and room response for the rows that use them, from (idx, w) and perhaps sample_rate."""
    empty = F.lit(None).cast("array<double>")
    for name, pool in (("noise", noises), ("rir", rirs)):
        if pool is None:
            rows = rows.withColumn(name, empty)
        else:
            rows = assigned(rows, _at_rate(pool, ["w"], sample_rate).select("idx", F.col("w").alias(name)), name, seed=seed).withColumnRenamed("idx", f"{name}_idx")
            rows = rows.withColumn(name, F.when(F.col(f"use_{name}"), F.col(name)))
    return rows


def enhancement_set(pairs: DataFrame, noises: DataFrame | None = None, rirs: DataFrame | None = None, chances: Chances = Chances(), samples: int | None = None, sample_rate: int = 16000, target: str = "image", seed: int = 0) -> DataFrame:
    """(key, ..., process_wav, clean_wav) from (key, w, clean).

    Here and below, a table with a column sample_rate has its waveforms resampled to ``sample_rate`` first.
    """
    rows = plan(_cut(_at_rate(pairs, ["w", "clean"], sample_rate), ["w", "clean"], "clean", samples, seed), chances, seed)
    return augmented(_with_clips(rows, noises, rirs, sample_rate, seed), sample_rate, target)


def extraction_set(rows: DataFrame, enrollments: DataFrame, single: float = 0.0, inactive: float = 0.0, vad: DataFrame | None = None, samples: int | None = None, noises: DataFrame | None = None, rirs: DataFrame | None = None, chances: Chances = TSE, sample_rate: int = 16000, seed: int = 0, enroll_mode: str = "given", beyond: bool = True) -> DataFrame:
    """Rows for target-speaker extraction, or for voice activity of that speaker where ``vad`` (key, labels) is given.

    ``rows`` has (key, idx, spk, all_spks, w, clean), ``enrollments`` (key, enroll). By chance the clean reference
    takes the mixture's place, or another speaker's row does and the target is the processed input itself (extraction)
    or all zeros (activity), flagged inactive. The enrollment is brought to its level and augmented on its own, but its
    volume changes with the mixture's. Labels follow the speed of what they mark: each place has the label of the
    nearest place before the change.
    With an ``enroll_mode`` other than "given", ``enrollments`` has the clips (key, pos, utt, w), see
    ``chosen_enrollments``. Without ``beyond`` a row whose draws all meet its own speakers stays active, see ``interferers``.
    """
    rows = _at_rate(rows, ["w", "clean"], sample_rate)
    enrollments = _at_rate(enrollments, ["enroll" if enroll_mode == "given" else "w"], sample_rate)
    if enroll_mode != "given":
        enrollments = chosen_enrollments(enrollments, enroll_mode, sample_rate, seed)
    lean = rows.select("key", "idx", "spk", "all_spks")
    picked = interferers(cases(lean, single, inactive, seed), seed=seed, beyond=beyond)
    other = rows.select(F.col("idx").alias("other_idx"), F.col("w").alias("other_w"), F.col("clean").alias("other_clean"))
    full = picked.join(rows.select("key", "w", "clean"), "key").join(other, "other_idx", "left")
    off = (F.col("case") == "inactive") & F.col("other_idx").isNotNull()
    swapped = full.withColumns(
        {"inactive": off, "w": F.when(off, F.when(F.col("use_mixture"), F.col("other_w")).otherwise(F.col("other_clean"))).when(F.col("case") == "single", F.col("clean")).otherwise(F.col("w"))}
    ).withColumn("clean", F.when(off, F.col("w")).otherwise(F.col("clean")))
    columns = ["w", "clean"]
    if vad is not None:
        swapped, columns = swapped.join(vad.select("key", "labels"), "key", "left"), [*columns, "labels"]
    swapped = swapped.drop("other_w", "other_clean")
    made = augmented(_with_clips(plan(_cut(swapped, columns, "clean", samples, seed, vad is None), chances, seed), noises, rirs, sample_rate, seed), sample_rate)
    made = made.withColumn("clean_wav", F.when(F.col("inactive"), F.col("process_wav")).otherwise(F.col("clean_wav")))
    if vad is not None:
        n = F.size("process_wav")
        made = made.withColumn("labels", F.when(F.col("inactive"), F.array_repeat(F.lit(0.0), n)).when(F.col("speed").isNotNull(), at_speed(F.col("labels"), F.col("speed"), n)).otherwise(F.col("labels")))
    clips = enrollment_clips(enrollments, noises, rirs, sample_rate, seed)
    louder = waves.clamped(waves.scaled(F.col("enroll"), F.col("volume")))
    return made.join(clips, "key", "left").withColumn("enroll", F.when(F.col("augmented") & (F.col("volume") != 1.0), louder).otherwise(F.col("enroll")))


def at_speed(labels: Column, speed: Column, n: Column) -> Column:
    """Labels of ``n`` places after a change of speed: place i was place i * speed before, to the nearest."""
    return waves.let(F.struct(labels.alias("l"), speed.alias("s")), lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(v["l"], F.least(F.floor(i * v["s"] + 0.5).cast("int"), F.size(v["l"]) - 1))))


def chosen_enrollments(clips: DataFrame, mode: str = "drawn", sample_rate: int = 16000, seed: int = 0) -> DataFrame:
    """(key, enroll) from clips (key, pos, utt, w): the "longest", the "shortest", all of them ("full"), 5 seconds of any one ("fixed_length"), or clips in a drawn order until they last a second ("drawn").

    What is taken is decided from lengths alone; the waveforms join after that.
    """
    lean = clips.select("key", "pos", "utt", (F.size("w") / F.lit(float(sample_rate))).alias("seconds"))
    if mode in ("longest", "shortest", "fixed_length"):
        taken = by_length(lean, "any" if mode == "fixed_length" else mode, seed).withColumn("nth", F.lit(0))
    elif mode == "full":
        taken = lean.withColumn("nth", F.col("pos"))
    elif mode == "drawn":
        taken = drawn_until(lean, 1.0, seed)
    else:
        raise ValueError(f"no such mode: {mode}")
    met = taken.select("key", "utt", "nth").join(clips.select("key", "utt", "w"), ["key", "utt"])
    out = met.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "w"))), lambda x: x["w"])).alias("enroll"))
    if mode == "fixed_length":
        n = 5 * sample_rate
        out = out.withColumn("enroll", F.when(F.size("enroll") > n, fixed_crop(F.col("enroll"), F.col("key"), sample_rate, 5.0, seed)).otherwise(F.col("enroll")))
    return out


def enrollment_clips(clips: DataFrame, noises: DataFrame | None, rirs: DataFrame | None, sample_rate: int = 16000, seed: int = 0) -> DataFrame:
    """(key, enroll, enroll_level) from (key, enroll): clips of a second at least, 15 seconds at most, at a drawn level, augmented."""
    long = clips.filter(F.size("enroll") >= sample_rate).select("key", F.slice("enroll", 1, 15 * sample_rate).alias("w"))
    level = long.withColumn("enroll_level", enrollment_level(F.col("key"), seed))
    rows = level.withColumn("w", waves.rescaled(F.col("w"), F.col("enroll_level"), "avg", "dB")).withColumn("clean", F.col("w"))
    made = augmented(_with_clips(plan(rows, ENROLLMENT, seed + 1), noises, rirs, sample_rate, seed + 1), sample_rate)
    return made.select("key", F.col("process_wav").alias("enroll"), "enroll_level")


def distance_set(rows: DataFrame, noises: DataFrame | None = None, chances: Chances = Chances(rir=0.0, response=0.0), samples: int | None = None, sample_rate: int = 16000, seed: int = 0) -> DataFrame:
    """(key, process_wav, near, far, near_inactive, far_inactive) from (key, w, near, far); both sides follow the mixture's speed and volume, a silent one is replaced by the processed mixture."""
    cut = _cut(_at_rate(rows, ["w", "near", "far"], sample_rate), ["w", "near", "far"], "w", samples, seed).withColumn("clean", F.col("w"))
    flagged = cut.withColumns({f"{s}_inactive": waves.silent(F.col(s)) for s in ("near", "far")})
    made = augmented(_with_clips(plan(flagged, chances, seed), noises, None, sample_rate, seed), sample_rate).drop("clean", "clean_wav")
    made = replayed(made, ["near", "far"])
    return made.withColumns({s: F.when(F.col(f"{s}_inactive"), F.col("process_wav")).otherwise(F.col(s)) for s in ("near", "far")})


def fixed_crop(w, key, sample_rate: int = 16000, seconds: float = 5.0, seed: int = 0):
    """A crop of fixed length at a drawn offset, padded if the clip is shorter."""
    n = int(sample_rate * seconds)
    return waves.cut(w, whole(key, "fixed", waves.room(w, n), seed), n)
