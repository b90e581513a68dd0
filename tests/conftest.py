import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """series({"a": [1.0, None, ...]}) -> series view, a row a minute."""
    import datetime

    def make(values: dict):
        start = datetime.datetime(2024, 1, 1)
        rows = [(name, k, start + datetime.timedelta(minutes=k), None if v is None else float(v)) for name, vs in values.items() for k, v in enumerate(vs)]
        return spark.createDataFrame(rows, "series_id string, idx long, timestamp timestamp_ntz, value double")

    return make
