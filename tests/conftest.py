import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    work = tempfile.mkdtemp(prefix="easel-tests-")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{work}/warehouse").config("spark.checkpoint.dir", f"file://{work}/shared").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def rows(spark):
    """rows(df, *columns): the collected rows as sorted tuples."""

    def get(df, *cols):
        cols = cols or df.columns
        return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)

    return get
