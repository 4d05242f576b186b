"""Clean a corpus of documents for training: quality, near-dedup, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs``; the last one returns the
token ids instead of the text. A stage works on all rows that it gets and drops or changes only what it decides on:
other columns pass through, null and empty texts too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import bpe, decontamination, near_dedup, quality, secret_scan
from earshot.llm.common import stored


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, longer if ``docs`` has a column of that name (case does not matter)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame], *own: str) -> DataFrame:
    """``work`` on ``docs`` with all columns but ``own`` under other names, so that it cannot touch them; the columns of ``docs`` come back."""
    names = {c: f"__column_{k}" for k, c in enumerate(docs.columns) if c not in own}
    out = work(docs.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns)))
    return out.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def _left_out(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is no value of the one column of ``gone``; a null matches a null."""
    mine, theirs = _unused(docs, "__key"), _unused(docs, "__gone")
    marked = docs.withColumn(mine, key)
    return marked.join(gone.toDF(theirs), F.col(mine).eqNullSafe(F.col(theirs)), "left_anti").select(*(f"`{c}`" for c in docs.columns))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below ``quality.ACCEPT`` go; without labels to learn from, none goes.

    A null text scores as an empty one; repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(quality.remainder(F.col("doc_id")) != 2).select("doc_id", F.col("quality").alias("good"))
    stats = stored(quality.with_statistics(docs.select("doc_id", "text")), "statistics")
    model = quality.fit(stats, labels)
    if not model.learned:
        return docs
    return _shielded(docs, lambda d: quality.scored_texts(d, model).filter("predicted = 1"), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays.

    Of rows that share that id one stays: the one with the smallest hash of its text, then of all its columns.
    Rows with a null id and rows without words are no duplicates of anything and stay.
    """
    gone = stored(near_dedup.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id").distinct(), "duplicates")
    left = _left_out(docs, F.col("doc_id").cast("bigint"), gone)
    repeated = stored(left.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    row, place = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.xxhash64("text"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    again = left.join(repeated, "doc_id", "left_semi").select(*(f"`{c}`" for c in docs.columns))
    once = again.groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, place).alias("row")).select("row.*")
    return _left_out(left, F.col("doc_id"), repeated).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a few word edits, go; null and wordless texts hold none."""
    # The text itself is leaked or not, so its fingerprint stands for the document.
    prints = F.xxhash64("text")
    found = decontamination.contaminated(docs.select(prints.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _left_out(docs, prints, stored(found.select("doc_id").distinct(), "leaked"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark; all rows stay, null texts stay null, and n_chars follows a changed text."""

    def work(rows: DataFrame) -> DataFrame:
        redacted = secret_scan.redact(secret_scan.scan_documents(rows))
        if "n_chars" not in docs.columns:
            return redacted
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        return redacted.withColumn("n_chars", F.when(F.size("secret_spans") > 0, length).otherwise(F.col("n_chars")))

    return _shielded(docs, work, "text", "n_chars")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens and token_ids of the whole text (columns of these names are replaced).

    A null or empty text has no tokens; repeated rows are kept, and an own column ``decoded`` passes through.
    """
    mine = _unused(docs, "__decoded")
    rows = docs.withColumnRenamed("decoded", mine)
    out = bpe.encoded(rows).drop("decoded")
    return out.withColumnRenamed(mine, "decoded")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("BPE encoding", tokenize),
]
#: The quality and BPE stages cannot be said in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage_{k}")
    return docs
