"""What is asked of the Kafka and JDBC sources, whose jars are absent here."""

import pytest

from querylume.sources import jdbc, messages


class Recorder:
    """Stands in for a reader or writer and records how it is set up."""

    def __init__(self):
        self.seen = {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def options(self, **given):
        self.seen.update(given)
        return self

    def mode(self, name):
        self.seen["mode"] = name
        return self

    def schema(self, schema):
        self.seen["schema"] = schema
        return self

    def load(self):
        return self

    def save(self):
        self.seen["saved"] = True

    def select(self, *cols):
        self.seen["selected"] = cols
        return self

    @property
    def read(self):
        return self

    readStream = write = read


KAFKA = {"format": "kafka", "kafka.bootstrap.servers": "host:9092", "subscribe": "queries"}


def test_kafka_starts_at_the_earliest_offset(spark):
    got = messages.message_stream(Recorder(), KAFKA, max_messages=50).seen
    assert got["format"] == "kafka" and got["subscribe"] == "queries"
    assert got["startingOffsets"] == "earliest" and got["maxOffsetsPerTrigger"] == "50"
    assert "schema" not in got
    later = messages.message_stream(Recorder(), {**KAFKA, "startingOffsets": "latest"}).seen
    assert later["startingOffsets"] == "latest" and "maxOffsetsPerTrigger" not in later


def test_files_are_limited_per_batch(spark):
    got = messages.message_stream(Recorder(), {"format": "parquet", "path": "/in"}, max_files=3).seen
    assert got["maxFilesPerTrigger"] == "3" and got["schema"] == messages.VALUE_SCHEMA
    assert "startingOffsets" not in got


def test_limits_are_in_the_unit_of_the_source(spark):
    with pytest.raises(ValueError, match="not by files"):
        messages.message_stream(Recorder(), KAFKA, max_files=3)
    with pytest.raises(ValueError, match="not by messages"):
        messages.message_stream(Recorder(), {"format": "parquet", "path": "/in"}, max_messages=3)


def test_a_batch_of_messages_ends_where_they_do_now(spark):
    got = messages.read_messages(Recorder(), KAFKA).seen
    assert got["startingOffsets"] == "earliest" and got["endingOffsets"] == "latest"


def test_messages_go_out_as_bytes(spark):
    sink = Recorder()
    messages.write_messages(sink, {"format": "kafka", "topic": "queries"})
    assert sink.seen["topic"] == "queries" and sink.seen["mode"] == "append"
    assert "encode" in str(sink.seen["selected"][0])


def test_rows_are_appended_over_few_connections():
    frame = Recorder()
    jdbc.write_jdbc(frame, "jdbc:x", "logs", user="u", password="p", connections=4)
    assert frame.seen == {
        "format": "jdbc", "url": "jdbc:x", "dbtable": "logs", "user": "u", "password": "p",
        "batchsize": "10000", "numPartitions": "4", "mode": "append", "saved": True}


@pytest.mark.parametrize("read, wanted", [
    (lambda s: jdbc.read_jdbc(s, "jdbc:x", "SELECT 1"), {"query": "SELECT 1"}),
    (lambda s: jdbc.read_jdbc_table(s, "jdbc:x", "logs", "query_id", 0, 100, 8),
     {"dbtable": "logs", "partitionColumn": "query_id", "lowerBound": "0", "upperBound": "100",
      "numPartitions": "8"}),
])
def test_reads_are_run_by_the_database(read, wanted):
    got = read(Recorder()).seen
    assert {k: got[k] for k in wanted} == wanted and got["fetchsize"] == "10000"
