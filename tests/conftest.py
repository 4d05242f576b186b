import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("earshot tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    """Values for comparison: floats to nine digits, lists as tuples."""
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compare a registered query with its SQL twin on the smallest tables."""

    def check(query, sql):
        rows = query(spark, SF)
        names = sorted(rows.columns)
        found = duck.execute(sql)
        theirs = [d[0] for d in found.description]
        assert sorted(theirs) == names
        at = [theirs.index(n) for n in names]
        want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
        got = sorted((tuple(plain(v) for v in r) for r in rows.select(*(f"`{n}`" for n in names)).collect()), key=repr)
        assert got == want
        return len(got)

    return check
