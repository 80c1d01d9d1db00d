from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("siltgate-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def frame(spark):
    """Build a tracked frame from rows of values and a schema string."""
    from siltgate.sources.tables import from_dataframe

    def build(rows, schema):
        numbered = [(i, *row) for i, row in enumerate(rows, start=1)]
        return from_dataframe(spark.createDataFrame(numbered, f"`__i` bigint, {schema}"), row_index="__i").tracked()

    return build


@pytest.fixture
def code():
    """The diagnostic code a call fails with."""
    from siltgate import EngineError

    def run(call, *args, **kwargs):
        with pytest.raises(EngineError) as caught:
            call(*args, **kwargs)
        return caught.value.code

    return run
