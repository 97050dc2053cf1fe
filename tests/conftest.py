import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config(
            map={
                "spark.sql.shuffle.partitions": "4",
                "spark.default.parallelism": "4",
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
                "spark.driver.memory": "4g",
                "spark.sql.session.timeZone": "UTC",
                "spark.checkpoint.dir": str(folder / "shared"),
                "spark.sql.warehouse.dir": str(folder / "warehouse"),
            }
        )
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
