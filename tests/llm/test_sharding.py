from collections import Counter

import pytest
from pyspark.sql import functions as F

from earshot.llm import sharding as S


def test_table_is_even_and_moves_little():
    full = S.fill_table()
    n = Counter(full)
    assert len(full) == S.TABLE_SIZE and max(n.values()) - min(n.values()) <= 1
    less = S.fill_table(S.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(full, less) if a != 63)
    assert moved < 0.1 * len(full)
    assert S.fill_table(("a",), 5) == [0] * 5


def test_first_turns_by_hand():
    shards = ("x", "y", "z")
    start = [S._draw(f"offset|{s}") % 7 for s in shards]
    step = [S._draw(f"step|{s}") % 6 + 1 for s in shards]
    want = {}
    order = [iter([(a + k * b) % 7 for k in range(7)]) for a, b in zip(start, step)]
    while len(want) < 7:
        for i, o in enumerate(order):
            if len(want) < 7:
                want[next(s for s in o if s not in want)] = i
    assert S.fill_table(shards, 7) == [want[s] for s in range(7)]


@pytest.mark.parametrize("shards,size", [((), 7), (("a", "a"), 7), (("a",), 8), (tuple(map(str, range(9))), 7)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        S.fill_table(shards, size)


def test_rows_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "doc_id long, slot string").withColumn("owners", F.lit(1))
    got = S.assign_shards(df)
    assert got.columns == ["doc_id", "owners", "slot", "shard", "shard_name"] and got.count() == 4
    assert got.filter("doc_id = 1").select("shard").distinct().count() == 1 and got.filter("shard IS NULL").count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert S.assign_shards(df.limit(0)).count() == 0
