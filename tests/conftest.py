import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="faultline-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a column function to values; yields the results in order."""

    def apply(function, values, kind="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        found = rows.select("i", function(F.col("v")).alias("r")).collect()
        return [r.r for r in sorted(found, key=lambda r: r.i)]

    return apply


@pytest.fixture
def make_events(spark):
    """Events of the fixed columns from (incident, second, level, service, message)."""

    def make(rows):
        from pyspark.sql import functions as F

        data = [(i, s, lv, sv, m, n) for n, (i, s, lv, sv, m) in enumerate(rows, 1)]
        frame = spark.createDataFrame(
            data, "incident_id string, s long, level string, service string, message string, seq long"
        )
        return frame.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")

    return make
