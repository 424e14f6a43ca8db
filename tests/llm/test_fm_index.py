import hashlib
import random
import re

import numpy as np
import pytest

from querylume.llm import fm_index
from querylume.llm.fm_index import FMIndex, contamination, find_passages, without_passages


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    found |= names
        joined = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out


def make_bench(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, hits int, items int")


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "42", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 30)))) for i in range(12)]
    items += [(50, "only three words"), (51, "w1"), (52, ""), (53, None), (54, "-- !"), (None, "a b, c d e"),
              (2, "w2 " * 14), (60, items[0][1]), (61, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    texts = [None, "", " ...", "w1", "Only-three WORDS only three words", "w2 " * 5000, "a b c d e"]
    for _ in range(80):
        parts = [" ".join(rng.choice(vocabulary + ["other", "new"]) for _ in range(rng.randrange(30)))]
        if rng.random() < 0.7:
            source = rng.choice(items)[1] or ""
            parts += [source[rng.randrange(1 + len(source) // 2):].upper(), "other w4 w5"]
        texts.append(", ".join(parts))
    return list(enumerate(texts)) + [(3, "w1 again")], items


@pytest.mark.parametrize("phrase_bytes", [1 << 24, 300])
def test_against_brute_force(spark, make_docs, phrase_bytes, monkeypatch):
    docs, items = corpus(random.Random(1))
    monkeypatch.setattr(fm_index, "PHRASE_BYTES", phrase_bytes)
    monkeypatch.setattr(find_passages, "__defaults__", (10, phrase_bytes))
    got = [tuple(r) for r in contamination(make_docs(*docs), make_bench(spark, items)).collect()]
    assert sorted(got) == sorted(slow(docs, items))


def test_no_documents_or_no_items(spark, make_docs):
    docs, items = corpus(random.Random(2))
    assert contamination(make_docs(*docs).limit(0), make_bench(spark, items)).collect() == []
    got = contamination(make_docs(*docs), make_bench(spark, [])).collect()
    assert len(got) == len(docs) and not any(r.contaminated for r in got)


def test_cut_texts(spark, make_docs):
    docs = [(0, "Before, one two\nthree -- after."), (1, "one two"), (2, "one, TWO; three!"), (3, None), (4, "é one two three é")]
    cleaned = without_passages(make_docs(*docs), make_bench(spark, [(1, "one two three")]))
    assert cleaned.columns == make_docs(*docs).columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {
        0: "Before,  -- after.", 1: "one two", 2: "!", 3: None, 4: "é  é"}


def test_index_counts_and_locates():
    rng = random.Random(7)
    for _ in range(30):
        runs = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 40))] for _ in range(rng.randrange(1, 8))]
        symbols = np.array([x for r in runs for x in [*r, 0]])
        index = FMIndex(symbols, 4)
        for n in (1, 2, 3, 6):
            phrases = np.array([[rng.randrange(1, 5) for _ in range(n)] for _ in range(10)])
            low, high = index.search(phrases)
            for phrase, a, b in zip(phrases.tolist(), low, high):
                want = [i for i in range(len(symbols) - n + 1) if symbols[i:i + n].tolist() == phrase]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_repeated_items_are_one_and_blocks_stay_small(spark, make_docs):
    docs, items = corpus(random.Random(4))
    many = items + [(99, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")] * 300
    bench = make_bench(spark, many)
    folder, n_blocks = fm_index._blocks(bench, 400)
    sizes = spark.read.parquet(folder).groupBy("block").count().collect()
    assert n_blocks > 2 and sum(r["count"] for r in sizes) == len(set(many)) < len(many) - 290
    got = fm_index.find_passages(make_docs(*docs), bench, 10, 400)
    want = {d: (w, h, i) for d, w, h, i, _, _ in slow(docs[:-1], many)}
    for r in got.filter("doc_id <> 3").collect():
        assert (r.n_words, sum(h["end"] - h["start"] for h in r.hits), len(r["items"])) == want[r.doc_id]
    empty = fm_index.contamination(make_docs(*docs), bench.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r.contaminated for r in empty)
