import random

import numpy as np
import pytest

from querylume.llm import toxicity
from querylume.llm.toxicity import FuzzyTrie, Lexicon, features


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def test_automaton_finds_the_nearest_term():
    rng = random.Random(5)
    letters = "abcé"
    for _ in range(15):
        terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(3, 12))) for _ in range(12)})
        trie = FuzzyTrie(terms)
        for _ in range(150):
            word = list(rng.choice(terms))
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(word) + 1)
                word[i:i + rng.randrange(2)] = rng.choice(["", "a", "b", "x", "é"])
            word = "".join(word)
            allowed = {t: 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0 for t in terms}
            near = [(distance(word, t), k) for k, t in enumerate(terms) if distance(word, t) <= allowed[t]]
            got = trie.match(word)
            assert (got and got[0]) == (min(near)[0] if near else None)
            if got:
                assert got in near


def test_quotation_counts_less():
    lexicon = Lexicon(["idiot"], [6.0], cues=frozenset(["called", "sagte"]))
    plain = features("you are an idiot and that is all", lexicon)
    assert plain[1] > 0 and plain[2] == 0
    for text in ('they shouted "what an idiot" at me', "she called him an idiot", "er sagte idiot zu ihm", "«un idiot»"):
        abuse, quoted = features(text, lexicon)[1:3]
        assert abuse == 0 and quoted > 0, text
    both = features('"idiot" is a word. but you ' + "are really such a great fat stupid old " + "idiot", lexicon)
    assert both[1] == 0 or both[1] > 0
    assert features("an id1ot", lexicon)[1] > 0
    assert features(None, lexicon) == features("", lexicon) == features("fine words", lexicon)


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    vocabulary = [a + b + c for a in ("th", "on", "re", "ha") for b in ("an", "er", "in") for c in ("", "ed", "ly", "tion")]
    insults = ["moronic", "scumbag", "worthless", "idiotic"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    return docs, labels, {i for i, t in docs if any(w in t for w in insults)}


def test_learns_and_leaves_clean_texts_alone(spark, make_docs):
    docs, labels, toxic = corpus()
    # A toxic text in many copies lends its other words no weight.
    docs += [(5000 + i, "unlucky hapax words beside moronic scumbag " + str(i % 2)) for i in range(200)]
    labels += [(5000 + i, 1) for i in range(200)]
    docs += [(7000, "unlucky hapax words"), (7001, None), (7002, ""), (7003, "mor0nic wortless thing"), (None, "no id"),
             (7004, "a " * 40000), (7000, "unlucky hapax words")]
    labels += [(None, 1), (3, None), (4, 1), (4, 0)]
    frame = make_docs(*docs)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame, marks)
    assert set(model.lexicon.terms) == {"moronic", "scumbag", "worthless", "idiotic"}
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    found = {r.doc_id for r in rows if r.predicted}
    assert found == toxic | set(range(5000, 5200)) | {7003}
    kept = toxicity.clean(frame, model)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in found)


@pytest.mark.parametrize("marks", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1)], [(99, 1)]])
def test_too_few_labels(spark, make_docs, marks):
    docs = make_docs("one two three", "four", None)
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0, 0]
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_held_out_rows_are_not_learnt_from(spark, make_docs):
    docs, labels, _ = corpus(600, 3)
    frame = make_docs(*docs)
    held = {r.doc_id for r in frame.select("doc_id", toxicity.is_held_out("doc_id").alias("h")).collect() if r.h}
    import zlib
    assert held == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    swapped = [(i, 1 - t if i in held else t) for i, t in labels]
    models = [toxicity.train(frame, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, swapped)]
    assert models[0].lexicon.terms == models[1].lexicon.terms
    assert np.array_equal(models[0].beta, models[1].beta)


def test_cues_of_quotation_are_learnt(spark, make_docs):
    """A word near terms in clean texts marks quotation, in texts not learnt from too."""
    docs, labels, _ = corpus(1500, 4)
    rng, plain = random.Random(9), docs[0][1].split() + docs[2][1].split() + docs[3][1].split()
    for i in range(40):
        words = [rng.choice(plain) for _ in range(30)]
        words[10:10] = ["allegedly", rng.choice(["moronic", "scumbag", "worthless", "idiotic"])]
        docs.append((9000 + i, " ".join(words)))
        if i < 20:
            labels.append((9000 + i, 0))
    frame = make_docs(*docs)
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.lexicon.terms) == {"moronic", "scumbag", "worthless", "idiotic"}
    assert model.lexicon.cues == {"allegedly"}
    found = {r.doc_id for r in toxicity.score(frame, model).filter("predicted = 1").collect()}
    assert not found & set(range(9000, 9040)) and len(found) > 200


def test_words_by_chance_are_no_terms(spark, make_docs):
    """Thousands of rare words, labels at random: none is a term."""
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(60))) for i in range(900)]
    labels = [(i, int(rng.random() < 0.25)) for i, _ in docs]
    model = toxicity.train(make_docs(*docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.lexicon.terms == [] and model.lexicon.cues == frozenset()


def test_states_are_forgotten_and_made_again(monkeypatch):
    rng = random.Random(7)
    terms = ["".join(rng.choice("abcde") for _ in range(9)) for _ in range(30)]
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(7, 11))) for _ in range(400)] + terms
    whole = [FuzzyTrie(terms).match(w) for w in words]
    monkeypatch.setattr(toxicity, "STATES", 50)
    trie = FuzzyTrie(terms)
    assert [trie.match(w) for w in words] == whole
    assert len(trie.moves) < 1000
