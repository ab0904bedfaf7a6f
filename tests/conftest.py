import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("cinderlog-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log_of(spark):
    """A minimal log from message texts."""

    def build(contents, event_ids=None):
        ids = event_ids or [f"E{i}" for i in range(1, len(contents) + 1)]
        rows = [
            (i, c, e, "t") for i, (c, e) in enumerate(zip(contents, ids, strict=True), 1)
        ]
        return spark.createDataFrame(
            rows, "LineId long, Content string, EventId string, EventTemplate string"
        )

    return build
