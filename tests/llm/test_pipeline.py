import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querylume.llm import pieces, simhash, toxicity
from llm.test_fm_index import slow as slow_passages
from llm.test_fm_index import words as passage_words
from llm.test_simhash import slow_fingerprint, slow_groups
from llm.test_suffix_dedup import slow as slow_repeats

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with toxic texts, copies, shared passages and benchmark items."""
    rng = random.Random(11)
    vocabulary = [a + b for a in ("an", "th", "or", "shé", "ing", "ed", "li") for b in ("er", "on", "st", "qu", "")]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice([".", "!\n", ""])

    shared = text(80)
    items = [(i, text(25)) for i in range(5)]
    texts = [None, "", " ", "short one"]
    for i in range(300):
        parts = [text(rng.randrange(20, 80))]
        if i % 5 == 0:
            parts.insert(rng.randrange(2), f"you moronic {rng.choice(vocabulary)} scumbag {rng.choice(vocabulary)} idiotic")
        if i % 7 == 0:
            parts.append(shared)
        if i % 9 == 0:
            parts.append(rng.choice(items)[1])
        parts.append(text(10))
        texts.append(" ".join(parts))
    texts += [texts[50]] * 5 + [texts[60].replace(" ", "  ")] + [texts[61] + " once", texts[61]]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t else None) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int("moronic" in (t or ""))) for i, t in enumerate(texts) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_against_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts_of(docs)
        path = str(tmp_path / str(k))
        stage(spark, docs, tables).write.parquet(path)
        docs = spark.read.parquet(path)
        after = texts_of(docs)
        assert docs.columns[:5] == COLUMNS and docs.count() == len(after)
        if name == "toxicity":
            want = {i: t for i, t in before.items() if "moronic" not in (t or "")}
        elif name == "simhash near duplicates":
            fps = {i: slow_fingerprint(t) for i, t in before.items()}
            of = slow_groups(list(set(fps.values())))
            first = {}
            for i in sorted(before):
                first.setdefault(of[fps[i]], i)
            want = {i: before[i] for i in first.values()}
        elif name == "suffix dedup":
            want = {i: None if t is None else x[4] for (i, t), x in zip(before.items(), slow_repeats(list(before.values())))}
            assert want != before
        elif name == "benchmark decontamination":
            found = {r[0]: r for r in slow_passages(list(before.items()), benchmark)}
            hit = {i for i, r in found.items() if r[5]}
            assert hit and all(after[i] == before[i] for i in before if i not in hit)
            assert all(len(passage_words(after[i])) == found[i][1] - found[i][2] for i in before)
            want = after
        else:
            model = pieces.PieceEncoder(corpus_pipeline.PIECES)
            for r in docs.collect():
                ids = model.segment(model.normalised(r.text)) if r.text else []
                assert r.pieces == ids and r.restored
            want = before
        assert after == want, name


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and all(r.restored for r in rows)


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_take_odd_tables(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert STAGE[name](spark, docs.limit(0), tables).collect() == []
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "the same text " * 40, None, "s", 3), (1, "the same text " * 40, None, "s", 3),
         (1, "another", "en", None, None), (2, "w " * 60000, "en", "s", 0), (None, "", "en", "s", 0)], docs.schema)
    odd = odd.select("*", *(F.lit("x").alias(c) for c in ("row", "dk", "th", "fp", "hits", "kept", "score", "pieces", "name")))
    out = STAGE[name](spark, odd, tables)
    rows = out.collect()
    assert set(odd.columns) <= set(out.columns)
    # Null, empty and wordless texts share the fingerprint zero, and equal rows one group.
    assert len(rows) == (4 if name.startswith("simhash") else 6)


def test_library_without_the_subpackage(tmp_path):
    """The entry module still imports, with the queries of the rest."""
    top = Path(corpus_pipeline.__file__).parent
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith(('querylume.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = list(e.queries())\n"
        "assert 'pipeline' not in names and not any(n.startswith('op') for n in names)\n"
        "assert set(e.oracle_sql()) <= set(names) and len(names) > 100\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
