"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

One pass over the texts makes a small table of statistics for each document; everything else works on that table.
Tasks sum the normal equations of their rows, Spark adds the sums up row by row of the matrix, and the driver
solves systems of a fixed size. Out-of-fold scores give the histogram for the isotonic fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stored

FOURIER = 192
FOLDS = 4
RIDGE = 1e-3
LENGTH_SCALE = 8.0
BINS = 2000
ACCEPT = 0.7
#: Bytes of text that a task works on at a time.
CHUNK = 2_000_000
SEED = 7

_BYTES = np.zeros((256, 10))
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"-()", b"!", b"#$%&*^~+=", b"|<>{}[]\\/_", b"@", b"\n", bytes(range(128, 256)))):
    _BYTES[list(_set), _k] = 1

STATISTICS = (
    "upper", "lower", "digit", "punctuation", "bang", "symbol", "markup", "at", "breaks", "high",
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct", "most_common", "repeated_next",
    "symbol_tail", "stop_tail", "line_words", "repeated_lines", "longest_word", "caps_words", "first_share",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS; zeros for a null, empty or blank text."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(data)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _BYTES / size
    length = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    tails = [w[-1] for w in words]
    stops = sum([t in b".,;:?" for t in tails])
    odd = sum([t in b"#$%&*!|@^~+=" for t in tails])
    caps = sum([w.isupper() and len(w) > 1 for w in seen]) / len(seen)
    same = sum([a == b for a, b in zip(words, words[1:])])
    mean = length.mean()
    return [
        *share.tolist(), float(np.log1p(size)), float(np.log1p(n)), float(mean), float(length.std()), len(seen) / n, max(seen.values()) / n, same / n,
        odd / n, stops / n, float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines), float(np.log1p(length.max())), caps, sum([w[:1].isupper() for w in words]) / n,
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``statistics`` (array of float)."""
    kept = [c for c in docs.columns if c not in (text, "statistics")]
    given = docs.select(*(f"`{c}`" for c in kept), docs[f"`{text}`"].alias("__text"))

    def work(batches):
        for batch in pieces(batches, "__text", CHUNK):
            rows = [statistics(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(rows, pa.list_(pa.float32()))], [*kept, "statistics"])

    return given.mapInArrow(work, ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in kept), "statistics array<float>"]))


def _rows(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, len(STATISTICS)))


@dataclass
class Model:
    """Everything that scoring needs; its size depends on the parameters alone."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    points: tuple[np.ndarray, np.ndarray]

    @property
    def learned(self) -> bool:
        """Whether there was any label to learn from."""
        return bool(self.weights.any())

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.points)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, after a constant; the draws depend on the seed alone."""
    rng = np.random.default_rng(SEED)
    turn = rng.normal(0, 1 / LENGTH_SCALE, (len(STATISTICS), FOURIER))
    phase = rng.uniform(0, 2 * np.pi, FOURIER)
    z = np.cos(np.clip(x, -8, 8) @ turn + phase) * np.sqrt(2 / FOURIER)
    return np.hstack([np.ones((len(x), 1)), z])


def isotonic(place: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of ``place``; returns each block's mean place and share of good."""
    blocks: list[list[float]] = []
    for p, g, c in zip(place, good, count):
        blocks.append([p * c, g, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def normal_equations(rows: DataFrame, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """For each fold the matrix [Z'Z | Z'y] of rows (statistics, good, fold), shape (FOLDS, D, D + 1)."""
    width = FOURIER + 1

    def sums(batches):
        total = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            x, y, fold = _rows(batch.column("statistics")), batch.column("good").to_numpy(), batch.column("fold").to_numpy()
            z = fourier((x - mean) / spread)
            for f in range(FOLDS):
                own = fold == f
                total[f, :, :-1] += z[own].T @ z[own]
                total[f, :, -1] += z[own].T @ y[own]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS * width), pa.int32()), pa.array(list(total.reshape(FOLDS * width, -1)), pa.list_(pa.float64()))], ["line", "sums"])

    def added(batches):
        # Rows of a partition have few lines of the matrix, each as often as there were tasks.
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, values in zip(batch.column("line").to_pylist(), batch.column("sums")):
                v = values.values.to_numpy()
                total[line] = total[line] + v if line in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["line", "sums"])

    schema = "line int, sums array<double>"
    out = np.zeros((FOLDS * width, width + 1))
    for r in rows.select("statistics", "good", "fold").mapInArrow(sums, schema).repartition("line").mapInArrow(added, schema).collect():
        out[r["line"]] = r["sums"]
    return out.reshape(FOLDS, width, width + 1)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of ``stats`` (doc_id, statistics) with labels (doc_id, good 0/1).

    A document labelled several times counts as often; null labels and ids count not at all. Without any label
    the model scores 0.5 everywhere.
    """
    kinds = range(len(STATISTICS))
    scale = stats.select([f(F.element_at("statistics", k + 1).cast("double")).alias(f"{n}{k}") for k in kinds for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([scale[f"m{k}"] or 0.0 for k in kinds])
    spread = np.array([scale[f"s{k}"] or 0.0 for k in kinds])
    spread[spread < 1e-9] = 1.0
    usable = labels.filter("doc_id IS NOT NULL AND good IN (0, 1)").select("doc_id", F.col("good").cast("double").alias("good"))
    rows = stored(stats.join(usable, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "labelled")
    parts = normal_equations(rows, mean, spread)
    whole = parts.sum(0)
    n = whole[0, 0]
    if not n:
        return Model(mean, spread, np.zeros(FOURIER + 1), (np.array([0.0]), np.array([0.5])))

    def solve(a: np.ndarray) -> np.ndarray:
        penalty = np.full(FOURIER + 1, RIDGE * max(a[0, 0], 1.0) + 1e-9)
        penalty[0] = 1e-9
        return np.linalg.solve(a[:, :-1] + np.diag(penalty), a[:, -1])

    held = [Model(mean, spread, solve(whole - p), (np.zeros(1), np.zeros(1))) for p in parts]

    def binned(batches):
        for batch in batches:
            x, fold = _rows(batch.column("statistics")), batch.column("fold").to_numpy()
            raw = np.zeros(len(x))
            for f, m in enumerate(held):
                raw[fold == f] = m.raw(x[fold == f])
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(raw, -0.5, 1.5) * BINS).astype(np.int32)), batch.column("good")], ["bin", "good"])

    bins = rows.select("statistics", "good", "fold").mapInArrow(binned, "bin int, good double").groupBy("bin").agg(F.sum("good").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    points = isotonic(np.array([(b["bin"] + 0.5) / BINS for b in bins]), np.array([b["good"] for b in bins]), np.array([b["n"] for b in bins]))
    return Model(mean, spread, solve(whole), points)


def scored(stats: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``stats`` without its statistics, with ``score`` and ``predicted``."""
    kept = [c for c in stats.columns if c not in ("statistics", "score", "predicted")]

    def work(batches):
        for batch in batches:
            s = np.clip(model.score(_rows(batch.column(batch.num_columns - 1))), 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(s), pa.array((s >= accept).astype(np.int32))], [*kept, "score", "predicted"])

    given = stats.select(*(f"`{c}`" for c in kept), "statistics")
    return given.mapInArrow(work, ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in kept), "score double", "predicted int"]))


def scored_texts(docs: DataFrame, model: Model, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, from their texts in one pass: the texts are read again, but cross no shuffle."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def work(batches):
        for part in pieces(batches, text, CHUNK):
            x = np.array([statistics(t) for t in part.column(text).to_pylist()], np.float32).astype(np.float64)
            s = np.clip(model.score(x), 0, 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= accept).astype(np.int32))], [*kept, "score", "predicted"])

    given = docs.select(*(f"`{c}`" for c in kept))
    return given.mapInArrow(work, ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in kept), "score double", "predicted int"]))


def remainder(doc_id):
    """crc32 of the id as text, modulo 4; 2 means held out. A null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4).cast("int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; repeated rows are scored alike, a null text as an empty one."""
    stats = stored(with_statistics(docs.select("doc_id", "text")), "statistics")
    usable = labels.filter(remainder(F.col("doc_id")) != 2).select("doc_id", F.col("quality").alias("good"))
    model = fit(stats, usable)
    return scored(stats, model).select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
