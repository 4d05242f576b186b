"""Connected components of a graph given as a table of links, in rounds of joins; nothing gathers at the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that links lead to.

    Each round takes the smallest label among a node and its neighbours, then the label's own label, so paths
    shrink by more than half. Links with a null end and loops add nothing. Each round's labels are a stored table.
    """
    ways = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = stored(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(ways).select("way.*").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")), "labels")
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("id").alias("a"), "component"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("heard"))
        near = stored(labels.join(heard, "id", "left").select("id", "component", F.least("component", "heard").alias("next")), "near")
        far = near.select(F.col("id").alias("next"), F.col("next").alias("further"))
        least = F.least("next", F.coalesce("further", "next"))
        labels = stored(near.join(far, "next", "left").select("id", least.alias("component"), (least < F.col("component")).alias("moved")), "labels")
        if labels.filter("moved").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
    raise RuntimeError(f"no end after {rounds} rounds")
