"""One local session for all tests."""

from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from usagelens import configure

    session = (
        SparkSession.builder.master("local[8]")
        .appName("usagelens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture()
def make_lines(spark):
    """Log lines from Python objects: ``make_lines(tool, {path: [record, ...]})``."""

    def build(tool: str, files: dict[str, list]):
        rows = []
        for path, records in files.items():
            for i, record in enumerate(records):
                text = record if isinstance(record, str) else json.dumps(record, separators=(",", ":"))
                # two blocks per file, so that order must hold across splits
                rows.append((path, tool, 0 if i < 3 else 1, i, text))
        return spark.createDataFrame(rows, "path string, tool string, block long, pos long, value string")

    return build
