import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyworks.session import SETTINGS
    from pyspark.sql import SparkSession

    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def same(left, right):
    """Two pandas frames with the same columns and rows, in any order."""
    assert sorted(left.columns) == sorted(right.columns)
    names = sorted(left.columns)
    a, b = (sorted(map(repr, x[names].astype(object).where(x[names].notna(), None).itertuples(index=False, name=None))) for x in (left, right))
    assert len(a) == len(b)
    norm = [[_plain(v) for v in x] for x in (a, b)]
    assert norm[0] == norm[1]


def _plain(row):
    import re

    row = re.sub(r"np\.\w+\(('?[^()]*'?)\)", r"\1", row)
    return re.sub(r"(?<=\d)\.0\b", "", row)
