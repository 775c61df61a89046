from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def panel_of(spark, values, start="1999-01-04", series="s"):
    """A one-series panel with the given sales from a Monday on."""
    rows = [(series, "i", "st", "CA", k, float(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id string, item_id string, store_id string, state_id string, k int, sales double")
    return df.selectExpr(
        "id", "item_id", "store_id", "item_id as dept_id", "item_id as cat_id", "state_id", f"date_add(date'{start}', k) as date", "sales", "false as is_filled", "cast(null as string) as event_name_1",
        "cast(null as string) as event_name_2", "0 as is_holiday", "30 as days_to_holiday", "30 as days_since_holiday", "false as closure", "0 as snap", "cast(2.5 as double) as sell_price",
    )
