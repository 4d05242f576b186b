"""Running sums, neighbours and stretches over keys of any length, in two levels.

Rows of a key are cut into blocks of their places. A block is scanned on its own, so one key spreads over as many tasks
as it has blocks; what a block hands on (its sums, its first and last row) is one row, and only these rows are scanned
key by key. The scanned blocks are stored, so that both levels agree and the rows are made once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.sources.store import stored

#: Places of a key that one block holds.
BLOCK = 65_536

#: One row in so many cuts its key before its rows are numbered, and a key has so many cuts at most.
CUT, CUTS = 16_384, 512


def _with_block(rows: DataFrame, order: str, size: int) -> DataFrame:
    return rows.withColumn("__block", F.floor(F.col(order) / F.lit(size)))


def _within(order: str):
    return Window.partitionBy("key", "__block").orderBy(order)


def _earlier_blocks():
    return Window.partitionBy("key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def _given_back(local: DataFrame, handed: DataFrame) -> DataFrame:
    """Both levels joined; null keys meet too.

    By a merge: a file of blocks is so small for its rows (runs, places, signs) that its size would have it broadcast,
    all rows of all keys to one task.
    """
    handed = handed.withColumnsRenamed({"key": "__key", "__block": "__number"})
    return local.join(handed.hint("merge"), F.col("key").eqNullSafe(F.col("__key")) & F.col("__block").eqNullSafe(F.col("__number"))).drop("__key", "__number")


def numbered(rows: DataFrame, order: list[str], name: str, one_in: int = CUT, most: int = CUTS) -> DataFrame:
    """``rows`` (key, ...) with ``name``, their number from 0 on within the key by ``order``, nulls last as in SQL.

    About one place in ``one_in``, told by its hash, cuts its key; of more than ``most`` cuts of a key some are left out
    evenly. What lies between two cuts is sorted and numbered on its own, so that no task sorts a long key whole, however
    its rows are spread; the counts of the parts before are added. Cuts and parts are so few that they are broadcast.
    Rows at one place stay in one part.
    """
    place = F.struct(*(x.alias(f"{c}{n}") for c in order for n, x in enumerate((F.col(c).isNull(), F.col(c)))))
    found = rows.filter(F.pmod(F.xxhash64(*order), F.lit(one_in)) == 0).groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_set(place)).alias("__all"))
    cuts = found.select("__key", F.filter("__all", lambda _, n: n % F.ceil(F.size("__all") / most) == 0).alias("__cuts"))
    steps = F.lit([1 << n for n in reversed(range(most.bit_length()))])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) <= F.col("__place"), at + step).otherwise(at))
    placed = rows.withColumn("__place", place).join(F.broadcast(cuts), F.col("key").eqNullSafe(F.col("__key")), "left")
    placed = placed.withColumn("__part", F.when(F.col("__cuts").isNull(), 0).otherwise(part))
    counts = placed.filter("__cuts IS NOT NULL").groupBy(F.col("key").alias("__of"), F.col("__part").alias("__number")).count()
    earlier = Window.partitionBy("__of").orderBy("__number").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__of", "__number", F.sum("count").over(earlier).alias("__before"))
    w = Window.partitionBy("key", "__part").orderBy(*(F.asc_nulls_last(c) for c in order))
    kept = [f"`{c}`" for c in rows.columns if c != name]
    local = placed.select(*kept, "__part", (F.row_number().over(w).cast("bigint") - 1).alias("__nth"))
    out = local.join(F.broadcast(before), F.col("key").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__number")), "left")
    return out.select(*kept, (F.col("__nth") + F.coalesce("__before", F.lit(0))).alias(name))


def carried(rows: DataFrame, order: str, sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, totals: dict[str, Column] | None = None, size: int = BLOCK) -> DataFrame:
    """``rows`` (key, ``order``, ...) with running sums, values of the row before (null for a key's first), and sums over the whole key.

    Rows at one place have the same running sum, that up to the last of them.
    """
    sums, lags, totals = sums or {}, lags or {}, totals or {}
    values = {f"__s_{c}": x for c, x in sums.items()} | {f"__l_{c}": x for c, x in lags.items()} | {f"__t_{c}": x for c, x in totals.items()}
    w = _within(order)
    scans = {c: F.sum(f"__s_{c}").over(w) for c in sums} | {c: F.lag(f"__l_{c}").over(w) for c in lags}
    if lags:
        scans["__nth"] = F.row_number().over(w)
    local = stored(_with_block(rows, order, size).withColumns(values).withColumns(scans), "blocks")
    added = [F.sum(c).alias(c) for c in (*(f"__s_{c}" for c in sums), *(f"__t_{c}" for c in totals))]
    blocks = local.groupBy("key", "__block").agg(*added, *(F.max_by(f"__l_{c}", order).alias(f"__l_{c}") for c in lags))
    before, next_to = _earlier_blocks(), Window.partitionBy("key").orderBy("__block")
    handed = blocks.select(
        "key", "__block",
        *(F.sum(f"__s_{c}").over(before).alias(f"__b_{c}") for c in sums),
        *(F.lag(f"__l_{c}").over(next_to).alias(f"__p_{c}") for c in lags),
        *(F.sum(f"__t_{c}").over(Window.partitionBy("key")).alias(f"__w_{c}") for c in totals),
    )
    out = _given_back(local, handed)
    made = {c: F.col(c) + F.coalesce(f"__b_{c}", F.lit(0)) for c in sums} | {c: F.when(F.col("__nth") == 1, F.col(f"__p_{c}")).otherwise(F.col(c)) for c in lags} | {c: F.col(f"__w_{c}") for c in totals}
    return out.select(*(f"`{c}`" for c in rows.columns if c not in made), *(x.alias(c) for c, x in made.items()))


def stretches(rows: DataFrame, order: str, columns: list[str], begins: Callable[[Column, Column], Column], name: str, size: int = BLOCK) -> DataFrame:
    """``rows`` (key, ``order``, ...) with ``name``, the number from 0 on of the stretch that a row is in.

    ``begins(before, own)`` says of two neighbours, as structs of ``columns``, whether the later one begins a stretch.
    """
    w = _within(order)
    own = F.struct(*columns)
    new = F.when(F.row_number().over(w) == 1, 0).otherwise(begins(F.lag(own).over(w), own).cast("int"))
    marked = _with_block(rows, order, size).withColumn("__new", new)
    local = stored(marked.withColumn("__at", F.sum("__new").over(w)), "blocks")
    blocks = local.groupBy("key", "__block").agg(F.sum("__new").alias("inner"), F.min_by(own, order).alias("first"), F.max_by(own, order).alias("last"))
    edges = blocks.withColumn("before", F.lag("last").over(Window.partitionBy("key").orderBy("__block")))
    edge = edges.select("key", "__block", "inner", F.when(F.col("before").isNull(), 0).otherwise(begins(F.col("before"), F.col("first")).cast("int")).alias("edge"))
    handed = edge.select("key", "__block", (F.col("edge") + F.coalesce(F.sum(F.col("inner") + F.col("edge")).over(_earlier_blocks()), F.lit(0))).alias("__start"))
    out = _given_back(local, handed)
    return out.select(*(f"`{c}`" for c in rows.columns if c != name), (F.col("__at") + F.col("__start")).alias(name))


def sliding(rows: DataFrame, order: str, behind: int, ahead: int, made: dict[str, Callable[[Window], Column]], size: int = BLOCK) -> DataFrame:
    """``rows`` (key, ``order``, ...) with columns over the ``behind`` rows before each row to the ``ahead`` rows after it, and ``nth``, its number from 1 on.

    ``made`` has for each column what makes it from a window. Rows near the end of a block go to the next block too, and
    near the start to the one before, which see them and give them up again. A block has as many rows as the window at least.
    """
    size = max(size, behind, ahead)
    placed = carried(rows, order, sums={"nth": F.lit(1)}, size=size)
    at, block = F.col("nth") - 1, F.floor((F.col("nth") - 1) / F.lit(size))
    homes = F.array_compact(F.array(block, F.when(at % size >= size - behind, block + 1), F.when((at % size < ahead) & (block > 0), block - 1)))
    dealt = placed.withColumns({"__home": block, "__block": F.explode(homes)})
    w = Window.partitionBy("key", "__block").orderBy("nth").rowsBetween(-behind, ahead)
    seen = dealt.withColumns({c: f(w) for c, f in made.items()}).filter("__home = __block")
    return seen.drop("__home", "__block")
