import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

# Only the driver sees the package, as on a cluster.
sys.path.insert(0, str(Path(__file__).parent.parent))
os.chdir("/")

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("repoquarry-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted rows as plain tuples."""
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
