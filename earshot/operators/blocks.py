"""Long recordings as rows of blocks: spectra, overlap-add and filters without a row or a task that holds a recording.

A blocked waveform has rows (key, block, samples): block b holds the samples from b * size on, all blocks but a key's
last are full. What an operation needs of a neighbour (a halo) travels as a row of its own to the neighbour's block, so
that one shuffle by (key, block) serves the whole operation and a recording of hours spreads over as many tasks as it
has blocks. Results are those of the same operation on one row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.manifests import indexed
from earshot.operators.scans import carried
from earshot.sources.store import stored

#: Samples of a block: ten seconds at 16 kHz.
BLOCK = 160_000


def cut(rows: DataFrame, size: int = BLOCK, w: str = "w") -> DataFrame:
    """(key, block, samples) of whole waveforms (key, w); null and empty ones give no block."""
    n = F.ceil(F.size(w) / F.lit(size)).cast("int")
    some = rows.filter(F.size(w) > 0)
    return some.select("key", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), F.col(w).cast("array<double>").alias("w")).select(
        "key", F.col("block").cast("bigint").alias("block"), F.slice("w", F.col("block") * size + 1, F.lit(size)).alias("samples")
    )


def joined(pieces: DataFrame, order: str, size: int = BLOCK) -> DataFrame:
    """(key, block, samples) of the recordings that pieces (key, ``order``, w) make one after another; ``order`` has no ties within a key.

    A piece's start is a running sum over sizes in two levels, so neither a recording nor its list of pieces is in one task.
    """
    some = pieces.filter(F.size("w") > 0).select("key", order, F.col("w").cast("array<double>").alias("w"))
    placed = indexed(some.select("key", order, F.size("w").cast("bigint").alias("n")), ["key", order], "at")
    starts = carried(placed, "at", sums={"stop": F.col("n")}).select("key", order, (F.col("stop") - F.col("n")).alias("start"))
    laid = some.join(starts, ["key", order])
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.size("w") - 1) / size)
    parts = laid.select("key", "start", "w", F.explode(F.sequence(first, last)).alias("block"))
    frm = F.greatest(F.col("block") * size - F.col("start"), F.lit(0))
    upto = F.least((F.col("block") + 1) * size - F.col("start"), F.size("w"))
    sliced = parts.select("key", "block", (F.col("start") + frm).alias("start"), F.slice("w", (frm + 1).cast("int"), (upto - frm).cast("int")).alias("part"))
    whole = F.sort_array(F.collect_list(F.struct("start", "part")))
    return sliced.groupBy("key", "block").agg(F.flatten(F.transform(whole, lambda x: x["part"])).alias("samples"))


def whole(blocks: DataFrame) -> DataFrame:
    """(key, w): recordings as one row each, for those that are short enough to be one."""
    order = F.sort_array(F.collect_list(F.struct("block", "samples")))
    return blocks.groupBy("key").agg(F.flatten(F.transform(order, lambda x: x["samples"])).alias("w"))


def sizes(blocks: DataFrame) -> DataFrame:
    """(key, n): samples of each recording."""
    return blocks.groupBy("key").agg(F.sum(F.size("samples")).cast("bigint").alias("n"))


def _halo(blocks: DataFrame, size: int, behind: int, ahead: int) -> DataFrame:
    """(key, block, offset, samples): each block's own samples at offset 0, and what its neighbours give it: up to ``behind`` samples before it and ``ahead`` after it."""
    ways = [F.struct(F.col("block").alias("block"), F.lit(0).alias("offset"), F.col("samples").alias("samples"))]
    own = F.size("samples")
    for d in range(1, -(-behind // size) + 1):
        # To the block d further on: what lies within ``behind`` of its start. Blocks with one after them are full.
        take = min(behind - (d - 1) * size, size)
        ways.append(F.struct((F.col("block") + d).alias("block"), F.lit(-(d - 1) * size - take).alias("offset"), F.slice("samples", F.lit(size - take + 1), F.lit(take)).alias("samples")))
    for d in range(1, -(-ahead // size) + 1):
        take = F.least(F.lit(min(ahead - (d - 1) * size, size)), own)
        ways.append(F.when(F.col("block") >= d, F.struct((F.col("block") - d).alias("block"), F.lit(d * size).alias("offset"), F.slice("samples", F.lit(1), take).alias("samples"))))
    return blocks.select("key", F.explode(F.array_compact(F.array(*ways))).alias("x")).select("key", "x.*")


def by_block(blocks: DataFrame, work: Callable[..., list[tuple]], schema: str, size: int, behind: int = 0, ahead: int = 0, taps: DataFrame | None = None) -> DataFrame:
    """Rows (key, ``schema``) that ``work(block, samples, at, n)`` makes of each block.

    ``samples`` has the block and its halo as far as the recording goes, ``at`` is the place of the block's first
    sample in it and ``n`` the block's own size. With ``taps`` (key, taps, lead) each block gets its key's too.
    """
    parts = _halo(blocks, size, behind, ahead)
    gathered = parts.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("offset", "samples"))).alias("parts"))
    # A halo sent beyond the last block meets no block there.
    gathered = gathered.filter(F.exists("parts", lambda x: x["offset"] == 0))
    gathered = gathered.select(
        "key", "block", F.flatten(F.transform("parts", lambda x: x["samples"])).alias("samples"),
        F.aggregate("parts", F.lit(0), lambda s, x: s + F.when(x["offset"] < 0, F.size(x["samples"])).otherwise(0)).alias("at"),
        F.aggregate("parts", F.lit(0), lambda s, x: s + F.when(x["offset"] == 0, F.size(x["samples"])).otherwise(0)).alias("n"),
    )
    if taps is not None:
        gathered = gathered.join(taps.select("key", "taps", "lead"), "key")
    kind, names = blocks.schema["key"].dataType.simpleString(), [c.split()[0] for c in schema.split(", ")]
    more = ["taps", "lead"] if taps is not None else []

    def rows(batches):
        for pdf in batches:
            for key, block, samples, at, n, *extra in pdf[["key", "block", "samples", "at", "n", *more]].itertuples(index=False):
                if extra:
                    extra = [None if extra[0] is None else np.asarray(extra[0], np.float64), extra[1]]
                made = work(int(block), np.asarray(samples, np.float64), int(at), int(n), *extra)
                if made:
                    yield pd.DataFrame([(key, *r) for r in made], columns=["key", *names])

    return gathered.mapInPandas(rows, f"key {kind}, {schema}")


def spectra(blocks: DataFrame, n_fft: int, hop: int, size: int = BLOCK) -> DataFrame:
    """(key, frame, re, im) as of ``signal.spectra``: a frame belongs to the block that it starts in."""
    from earshot.functions.kernels import stft

    def work(block, samples, at, n):
        first = -(-block * size // hop)
        skip = first * hop - block * size
        if skip >= n:
            return []
        re, im = stft(samples[at + skip :], n_fft, hop)
        m = min(len(re), (n - skip - 1) // hop + 1)
        return [(first + k, re[k], im[k]) for k in range(m)]

    return by_block(blocks, work, "frame bigint, re array<double>, im array<double>", size, 0, n_fft - 1)


def waveforms(frames: DataFrame, n_fft: int, hop: int, size: int = BLOCK) -> DataFrame:
    """(key, block, samples) from spectra (key, frame, re, im), as of ``signal.waveforms``.

    Frames that start in a block are added up there, with their squared windows; what reaches over the block's end is
    sent on and added to the sums of the next. Frames of a key are numbered from 0 without gaps.
    """
    from earshot.functions.kernels import hann

    kind = frames.schema["key"].dataType.simpleString()
    placed = frames.withColumn("block", F.floor(F.col("frame") * hop / F.lit(size)))

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, window = int(key[1]), hann(n_fft)
        at = pdf["frame"].to_numpy() * hop - block * size
        parts = np.fft.irfft(np.stack(pdf["re"].to_numpy()) + 1j * np.stack(pdf["im"].to_numpy()), n_fft, axis=1) * window
        sums, weight = np.zeros(int(at.max()) + n_fft), np.zeros(int(at.max()) + n_fft)
        for a, p in zip(at.tolist(), parts):
            sums[a : a + n_fft] += p
            weight[a : a + n_fft] += window * window
        cuts = range(0, len(sums), size)
        return pd.DataFrame([(key[0], block + k, sums[c : c + size], weight[c : c + size]) for k, c in enumerate(cuts)], columns=["key", "block", "sums", "weight"])

    sums = placed.groupBy("key", "block").applyInPandas(add, f"key {kind}, block bigint, sums array<double>, weight array<double>")

    def total(xs: Column, name: str) -> Column:
        # Parts of a block start together and differ in length.
        longest = F.array_max(F.transform(xs, lambda x: F.size(x[name])))
        none = F.array_repeat(F.lit(0.0), longest)
        return F.aggregate(xs, none, lambda s, x: F.zip_with(s, x[name], lambda a, b: a + F.coalesce(b, F.lit(0.0))))

    met = sums.groupBy("key", "block").agg(F.collect_list(F.struct("sums", "weight")).alias("parts"))
    met = met.select("key", "block", total(F.col("parts"), "sums").alias("sums"), total(F.col("parts"), "weight").alias("weight"))
    return met.select("key", "block", F.zip_with("sums", "weight", lambda s, v: F.when(v > 1e-10, s / F.greatest(v, F.lit(1e-10))).otherwise(s)).alias("samples"))


def filtered(blocks: DataFrame, taps: DataFrame, size: int = BLOCK) -> DataFrame:
    """(key, block, samples): each recording convolved with its key's ``taps`` (key, taps, lead), moved back by ``lead`` samples, at its own size.

    Overlap-save: a block sees as many samples before and after it as the longest taps reach. ``lead`` 0 looks back
    only, half the taps centres them, a response's delay takes the delay away. Blocks of a key without taps go; a null
    or empty array of taps gives zeros. The taps meet the blocks by key, and adaptive execution can split a long recording there.
    """
    from earshot.functions.kernels import convolve

    taps = stored(taps.select("key", F.coalesce(F.col("taps"), F.array().cast("array<double>")).cast("array<double>").alias("taps"), F.col("lead").cast("bigint").alias("lead")), "taps")
    reach = taps.agg(F.max(F.size("taps") - 1 - F.col("lead")).alias("behind"), F.max("lead").alias("ahead")).first()
    behind, ahead = max(reach["behind"] or 0, 0), max(reach["ahead"] or 0, 0)

    def work(block, samples, at, n, h, lead):
        if h is None or not len(h):
            return [(block, np.zeros(n))]
        full = convolve(samples, h)
        out = np.zeros(n)
        part = full[at + int(lead) : at + int(lead) + n]
        out[: len(part)] = part
        return [(block, out)]

    return by_block(blocks, work, "block bigint, samples array<double>", size, behind, ahead, taps)


def room_taps(responses: DataFrame, sample_rate: int, mode: str = "image") -> DataFrame:
    """(key, taps, lead) of room responses (key, h), for ``filtered``: at unit energy, whole or cut after the peak, without their delay."""
    from earshot.functions.kernels import response
    from earshot.functions.signal import by_row

    def made(h):
        taps = response(np.asarray(h, np.float64), sample_rate, mode)
        return {"taps": taps if len(taps) else np.ones(1), "lead": int(np.argmax(np.abs(taps))) if len(taps) else 0}

    return by_row(responses.select("key", "h"), made, "taps array<double>, lead bigint", ["h"]).select("key", "taps", "lead")
