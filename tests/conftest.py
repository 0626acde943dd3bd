from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.defaultSizeInBytes": "1000000",  # frames made of tuples count as small
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(spark):
    """Treat every key of a few rows as hot and every input as large, so the split paths run on small data."""
    spark.conf.set("spark.clickloom.scanBytes", "0")
    spark.conf.set("spark.clickloom.hotRows", "7")
    spark.conf.set("spark.clickloom.pairBlock", "3")
    yield spark
    spark.conf.unset("spark.clickloom.scanBytes")
    spark.conf.unset("spark.clickloom.hotRows")
    spark.conf.unset("spark.clickloom.pairBlock")


@pytest.fixture
def frame(spark):
    """A DataFrame from tuples and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
