from querylume.operators import quality
from querylume.schema import STREAM_COLUMNS, TEXT_SCHEMA


def described(df):
    return {r.query_id: r.anomaly_description for r in quality.anomalies(df).collect()}


def test_a_clean_row_has_no_anomaly(make_log):
    assert described(make_log({})) == {}


def test_one_row_per_rule(make_log):
    got = described(make_log(
        {"query_type": "bogus"},
        {"query_type": None},
        {"read_table_ids": None},
        {"read_table_ids": ""},
        {"query_type": "insert", "write_table_ids": None},
        {"read_table_ids": "5,00"},
        {"read_table_ids": "0000,00,1"},
        {"query_type": "insert", "write_table_ids": "000"},
        {"execution_duration_ms": -1.0},
        {"execution_duration_ms": 0.0, "was_cached": 0},
        {"execution_duration_ms": 0.0, "was_cached": None},
        {"execution_duration_ms": 0.0, "was_cached": 1},
        {"query_type": "update", "read_table_ids": None},
    ))
    assert got == {
        1: "Invalid query_type `bogus`",
        2: "Invalid query_type `None`",
        3: "Missing read_table_ids for `select` query",
        4: "Missing read_table_ids for `select` query",
        5: "Missing write_table_ids for `insert` query",
        6: "read_table_ids contains invalid values {'00'}",
        7: "read_table_ids contains invalid values {'00', '0000'}",
        8: "write_table_ids contains invalid values {'000'}",
        9: "execution_duration_ms is negative (-1.0)",
        10: "Query executed instantly but was not cached",
        11: "Query executed instantly but was not cached",
    }


def test_messages_are_joined_in_rule_order(make_log):
    got = described(make_log({
        "query_type": "copy", "read_table_ids": None, "write_table_ids": "00",
        "execution_duration_ms": 0.0, "was_cached": 0}))
    assert got[1] == (
        "Missing read_table_ids for `copy` query"
        " | write_table_ids contains invalid values {'00'}"
        " | Query executed instantly but was not cached")


def test_type_rule_on_text(spark):
    good = ["1", "1", "2024-01-01T00:00:00", "1.5", "3", "1", "select", "1", None, "2.0", "4"]

    def row(**changes):
        return tuple(changes.get(c, v) for c, v in zip(STREAM_COLUMNS, good))

    rows = [
        row(query_id="1"),
        row(query_id="2", num_joins='"NaN"', compile_duration_ms='"NaN"', user_id=None),
        row(query_id="3", num_joins="many"),
        row(query_id="4", num_joins="2.5", execution_duration_ms="3.5"),
        row(query_id="5", arrival_timestamp="soon"),
        row(query_id="6", compile_duration_ms="fast", user_id="x"),
    ]
    df = spark.createDataFrame(rows, TEXT_SCHEMA)
    assert described(df) == {
        3: "num_joins expected int, found text",
        4: "execution_duration_ms expected int, found float | num_joins expected int, found float",
        5: "arrival_timestamp expected datetime64[ns], found text",
        6: "user_id expected int, found text | compile_duration_ms expected float, found text",
    }
    late = [r for r in quality.anomalies(df).collect() if r.query_id == 5]
    assert late[0].arrival_timestamp is None


def test_anomalies_need_no_shuffle(make_log):
    plan = quality.anomalies(make_log({}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_latest_anomalies(make_log):
    log = make_log(*[
        {"arrival_timestamp": f"2024-01-01T10:{i:02d}:00", "execution_duration_ms": -1.0}
        for i in range(15)])
    found = quality.anomalies(log)
    got = [r.query_id for r in quality.latest_anomalies(found, "2024-01-01 10:03:00", 10).collect()]
    assert got == list(range(15, 5, -1))
    few = quality.latest_anomalies(found, "2024-01-01 10:12:00").collect()
    assert [r.query_id for r in few] == [15, 14]


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "n int, t string")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["n", "t"]).collect()] == [(1, "a", 2)]
