"""Every query against its SQL twin at the smallest scale, and the entry contract."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as contract  # noqa: E402
import pairs  # noqa: E402
import verify  # noqa: E402
from pairs.base import TABLES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(pairs.QUERIES))
def test_pair(spark, con, name):
    text, _, ok = verify.compare(spark, con, SF_DIR, name)
    assert ok, text


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    frame = contract.entry(spark)
    assert frame.columns == ["average_precision"]
    assert frame.count() == 1


def test_merged_lists_are_written_by_tasks(spark):
    frame = pairs.QUERIES["src02_read_merged"](spark, SF_DIR)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    newest = max((os.path.join(folder, n) for n in os.listdir(folder) if n.startswith("merged-")), key=os.path.getmtime)
    files = [n for _, _, names in os.walk(newest) for n in names if not n.startswith(".")]
    assert files and all(n.endswith(".json") for n in files)  # no marker of a commit by the driver
    assert frame.count() > 0
