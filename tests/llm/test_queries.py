"""The registered queries: against their SQL where they have one, else whole and typed."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare
from querylume.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and "pipeline" in contract.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 1 + len(QUERIES))}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    state, note, _ = compare(spark, con, name, SF)
    assert state == "ok", note


DOCUMENTS = ("op2", "op3", "op4", "op5", "op6", "op7", "op8", "op11", "op12", "op13")
FIRST = {
    "op2": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op5": {"doc_id", "fingerprint", "component_id"},
    "op6": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op7": {"doc_id", "held_out", "score", "predicted"},
    "op8": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(DOCUMENTS)])
def test_every_document_has_its_row(spark, con, name):
    df = QUERIES[name](spark, SF)
    ids = con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()
    assert sorted((r.doc_id,) for r in df.collect()) == ids
    assert FIRST.get(name.split("_")[0], set()) <= set(df.columns)
