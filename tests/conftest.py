import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from vigil.session import local_session  # noqa: E402

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = local_session(cores="*", shuffle_partitions=8, app="vigil-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="vigil-test-")


def lines_df(spark, lines, col="value"):
    return spark.createDataFrame([(x,) for x in lines], f"{col} string")


def events_df(spark, rows):
    """rows: dicts with message and optional source/hostname/severity/timestamp/id/parsed_fields."""
    from vigil.schema import EVENT
    out = []
    for i, r in enumerate(rows):
        out.append((
            r.get("id", f"e{i:04d}"),
            r.get("timestamp", dt.datetime(2024, 4, 15, 10, 0, i % 60, tzinfo=UTC)),
            r.get("source", "auth"),
            r.get("hostname", "gate7"),
            r.get("severity", "low"),
            r["message"],
            r.get("raw", r["message"]),
            r.get("parsed_fields", {}),
            r.get("ip_addresses"),
            r.get("geo"),
        ))
    return spark.createDataFrame(out, EVENT)
