import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from eventlens import LogFacts  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("eventlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def facts_of(spark):
    """Lazy fact tables of one log given as a list of events (dicts or raw lines)."""

    def make(events, log_id="app", **options):
        rows = [
            (log_id, i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)
        ]
        lines = spark.createDataFrame(rows, "log_id string, seq bigint, value string")
        return LogFacts(spark, lines, **options)

    return make


def rows(df, *columns):
    """Rows as tuples, in a stable order."""
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
