"""Settings written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(v: Column) -> Column:
    """Only "true" and "yes" are, in any case."""
    return F.lower(v).isin("true", "yes")


def listed(v: Column) -> Column:
    """Items between white space."""
    return F.split(F.trim(v), r"\s+")


def span(v: Column) -> Column:
    """"least,most" as a struct of doubles."""
    parts = F.split(v, ",")
    return F.struct(F.element_at(parts, 1).cast("double").alias("least"), F.element_at(parts, 2).cast("double").alias("most"))
