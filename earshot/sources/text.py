"""Manifest and metadata files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.manifests import assembled, parsed, unmatched
from earshot.sources.quarantine import parted
from earshot.sources.store import stored

#: The columns of corpus metadata files.
CORPUS = "uttid string, spkid string, gender string, path string, length bigint, sample_rate int, channels int"
#: Manifests of each kind of dataset, the main one first.
FOLDERS = {"ns": ("wav2scp", "wav2ref"), "tse": ("wav2scp", "wav2ref", "ref2list", "ref2spk", "wav2spk"), "pvad": ("wav2scp", "ref2list", "ref2spk", "wav2spk", "ref2vad"), "dss": ("wav2scp", "ref2near", "ref2far")}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file or folder; line numbers rise within a file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def manifest(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """(key, vals) of a manifest file; the last line of a key counts."""
    return parsed(lines(spark, path), separator)


def folder(spark: SparkSession, path: str, task: str) -> tuple[DataFrame, DataFrame]:
    """A dataset folder's manifests assembled by key, and the keys that the main one lacks. A missing file is an error of the read."""
    main, *others = FOLDERS[task]
    read = {name: manifest(spark, f"{path}/{name}.txt") for name in others}
    first = manifest(spark, f"{path}/{main}.txt")
    return assembled(first, **read), unmatched(first, **read)


def corpus(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Corpus metadata (CORPUS and line_no) of a comma-and-space separated file with a header, paths below ``root``."""
    rows = spark.read.csv(path, header=True, schema=CORPUS, sep=",", ignoreLeadingWhiteSpace=True)
    where = F.concat_ws("/", F.lit(root), "path") if root else F.col("path")
    return rows.withColumn("path", where).withColumn("line_no", F.monotonically_increasing_id())


#: Name of the column that holds a line which the schema does not fit.
BROKEN = "broken_line"


def checked_corpus(spark: SparkSession, path: str, root: str | None = None, header: bool = True) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Corpus metadata as of ``corpus``, the lines that are no metadata, with their ``problem`` and as they stand (BROKEN), and counts.

    A line is malformed if it has fewer or more fields or a word where a number belongs; otherwise it may lack its id,
    its path, or a length or rate above zero.
    """
    schema = f"{CORPUS}, {BROKEN} string"
    read = spark.read.csv(path, header=header, schema=schema, sep=",", ignoreLeadingWhiteSpace=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    none = lambda c: F.coalesce(c, F.lit(0)) <= 0
    problems = {"malformed": F.col(BROKEN).isNotNull(), "no_id": empty("uttid") | empty("spkid"), "no_path": empty("path"), "no_length": none("length"), "no_rate": none("sample_rate")}
    good, bad, counts = parted(read.withColumn("line_no", F.monotonically_increasing_id()), problems, "metadata")
    where = F.concat_ws("/", F.lit(root), "path") if root else F.col("path")
    return good.drop(BROKEN).withColumn("path", where), bad, counts


def checked_mixtures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Mixtures as of ``mixtures``, those without an id of two utterances or without a path, with their ``problem``, and counts."""
    empty = F.lit(False)
    for c in ("mixture_path", "source_1", "source_2"):
        empty = empty | (F.coalesce(F.trim(c), F.lit("")) == "")
    named = F.coalesce(F.col("mixture_id").rlike(r"^[^_]+-[^_]*_[^_]+-[^_]*$"), F.lit(False))
    return parted(mixtures(spark, path), {"bad_id": ~named, "no_path": empty}, "mixtures")


def mixtures(spark: SparkSession, path: str) -> DataFrame:
    """(mixture_id, mixture_path, source_1, source_2): the first four columns of a CSV with a header, whatever their names."""
    rows = spark.read.csv(path, header=True)
    return rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, ("mixture_id", "mixture_path", "source_1", "source_2"))))


def write_manifests(rows: DataFrame, path: str, columns: dict[str, str], key: str = "key", compression: str | None = None, keep: bool = True) -> None:
    """One folder of text for each manifest name of ``columns``: lines "key value..." in order of the key. Arrays give several values.

    The rows are made and stored once, if they do not (``keep`` false) come from a stored table; each manifest sorts the
    key and its own column of them. ``compression`` is one of Spark's text writer, such as "gzip".
    """
    kept = stored(rows.select(key, *dict.fromkeys(columns.values())), "manifest_rows") if keep else rows
    for name, column in columns.items():
        value = F.concat_ws(" ", column) if rows.schema[column].dataType.typeName() == "array" else F.col(column).cast("string")
        kept.orderBy(key).select(F.concat_ws(" ", F.col(key).cast("string"), value)).write.mode("overwrite").text(f"{path}/{name}.txt", compression=compression or "none")


def write_report(scores: DataFrame, means: DataFrame, path: str) -> None:
    """A table of scores by utterance as Parquet, and its one-row summary as CSV."""
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    means.coalesce(1).write.mode("overwrite").csv(f"{path}/summary", header=True)
