"""Bad rows aside: each keeps the name of its first problem, is counted on the way and stored where it can be looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from earshot.sources.store import stored


def judged(rows: DataFrame, problems: dict[str, Column]) -> DataFrame:
    """``rows`` with ``problem``: the name of the first of ``problems`` that holds of a row, null for a good one. A problem that is null does not hold."""
    names = [F.when(found, F.lit(name)) for name, found in problems.items()]
    return rows.withColumn("problem", F.coalesce(*names) if names else F.lit(None).cast("string"))


def parted(rows: DataFrame, problems: dict[str, Column], name: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The good rows, the bad ones with their problem, and how many rows had which problem ("rows" is all of them).

    The rows are stored once; the counts are taken while they are written.
    """
    seen = Observation()
    counts = [F.count_if(F.col("problem") == p).alias(p) for p in problems]
    kept = stored(judged(rows, problems).observe(seen, F.count("*").alias("rows"), *counts), name)
    return kept.filter("problem IS NULL").drop("problem"), kept.filter("problem IS NOT NULL"), dict(seen.get)


def put_aside(bad: DataFrame, path: str, source: str) -> None:
    """Add bad rows to the quarantine at ``path``: (source, problem, row as JSON)."""
    columns = F.to_json(F.struct(*(F.col(f"`{c}`") for c in bad.columns if c != "problem")))
    bad.select(F.lit(source).alias("source"), "problem", columns.alias("row")).write.mode("append").partitionBy("source").parquet(path)
