from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from parcelflow.session import SETTINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("parcelflow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.local.dir", f"{scratch}/local")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def scratch():
    """A folder of its own for each test."""
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(df, *order):
    """Rows as tuples, sorted, for comparisons with literals."""
    data = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(data, key=repr)
