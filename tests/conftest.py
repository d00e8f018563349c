import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    """'01-05' -> 2024-01-05; a full date or None as it is."""
    if text is None:
        return None
    return dt.date.fromisoformat(text if len(text) > 5 else f"2024-{text}")


@pytest.fixture
def frame(spark):
    """Make a frame from rows; columns of type date take short texts."""
    def make(schema, *rows):
        kinds = [part.split()[-1] for part in schema.split(",")]
        data = [tuple(day(v) if k == "date" else v for v, k in zip(row, kinds)) for row in rows]
        return spark.createDataFrame(data, schema)
    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
