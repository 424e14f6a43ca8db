import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from querylume.schema import LOG_SCHEMA, STREAM_COLUMNS  # noqa: E402
from querylume.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", 8,
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def at(text):
    return datetime.datetime.fromisoformat(text)


# A clean row: every rule is satisfied.
CLEAN = {
    "user_id": 1, "query_id": 1, "arrival_timestamp": "2024-01-01T10:00:00",
    "compile_duration_ms": 5.0, "execution_duration_ms": 10.0, "was_cached": 0,
    "query_type": "select", "read_table_ids": "1,2", "write_table_ids": None,
    "num_joins": 2, "num_scans": 3,
}


@pytest.fixture
def make_log(spark):
    """A typed log from rows that differ from the clean row as given."""
    def make(*changes):
        rows = []
        for i, change in enumerate(changes):
            row = {**CLEAN, "query_id": i + 1, **change}
            if isinstance(row["arrival_timestamp"], str):
                row["arrival_timestamp"] = at(row["arrival_timestamp"])
            rows.append(tuple(row[c] for c in STREAM_COLUMNS))
        return spark.createDataFrame(rows, LOG_SCHEMA)
    return make


def final_plan(df):
    """The physical plan as run, after adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def first_plan(df):
    """The physical plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()
