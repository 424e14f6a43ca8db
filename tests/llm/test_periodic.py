import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from querylume.llm import periodic
from querylume.llm.grammar import Grammar
from querylume.llm.periodic import digests, periodic_runs, runs_of, with_planted_runs


def slow_runs(words):
    """All runs, by walking every period over every place."""
    best = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def slow_planted(doc_id, words):
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def slow_row(doc_id, text):
    words = slow_planted(doc_id, (text or "").encode().split())
    runs = slow_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    one = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *one, one[1] and math.floor(1000 * one[1] / one[2]),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


SEQUENCES = st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4)


@settings(max_examples=300, deadline=None)
@given(SEQUENCES)
def test_runs_of_short_alphabets(sequences):
    got = list(zip(*(x.tolist() for x in runs_of([np.array(s, np.int64) for s in sequences]))))
    assert got == [(k, *r) for k, s in enumerate(sequences) for r in slow_runs(s)]


@pytest.mark.parametrize("base,times", [("ab", 40), ("a", 90), ("aab", 30), ("abcdefgabcdefh", 6), ("abaab", 17)])
def test_runs_within_runs(base, times):
    words = [ord(c) for c in "xy" + base * times + "z" + (base * 5)[1:] + "yx"]
    got = list(zip(*(x.tolist() for x in runs_of([np.array(words)])[1:])))
    assert got == slow_runs(words)
    fib = "a", "ab"
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    words = [ord(c) for c in fib[1]]
    assert list(zip(*(x.tolist() for x in runs_of([np.array(words)])[1:]))) == slow_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=80), st.data())
def test_extensions_against_comparison(middle, data):
    symbols = np.array([2, *middle, 3])
    grammar = Grammar(symbols)
    i = data.draw(st.integers(1, len(symbols) - 2))
    j = data.draw(st.integers(1, len(symbols) - 2).filter(lambda x: x != i))
    forward = 0
    while max(i, j) + forward < len(symbols) and symbols[i + forward] == symbols[j + forward]:
        forward += 1
    back = 0
    while min(i, j) - back > 0 and symbols[i - back - 1] == symbols[j - back - 1]:
        back += 1
    assert grammar.extensions([i], [j]).tolist() == [forward]
    assert grammar.extensions_back([i], [j]).tolist() == [back]


def check(make_docs, rows):
    docs = make_docs(*rows)
    key = lambda r: tuple((x is None, x) for x in r)
    got = digests(periodic_runs(with_planted_runs(docs))).collect()
    assert sorted(map(tuple, got), key=key) == sorted((slow_row(*r) for r in rows), key=key)


def test_documents(make_docs, monkeypatch):
    rng = random.Random(5)
    line = "a line of text that repeats\n"
    texts = [None, "", " \t\n", "x", line * 40, "y " + line * 3 + "end", "na " * 5, "na " * 6, "né\x1c né né " * 9]
    for _ in range(150):
        words = [rng.choice(["an", "thé", "or", "ing"]) for _ in range(rng.randrange(80))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = [rng.choice("abc") for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9)
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    check(make_docs, list(enumerate(texts)))
    monkeypatch.setattr(periodic, "QUERIES_AT_ONCE", 7)
    got = runs_of([np.array([names for names in map(ord, "ab" * 30 + "c" * 30)])])
    assert list(zip(*(x.tolist() for x in got[1:]))) == slow_runs("ab" * 30 + "c" * 30)


def test_repeated_rows_nulls_and_no_rows(make_docs):
    check(make_docs, [(1, "a b " * 8), (1, "a b " * 8), (1, "c " * 7), (None, "d e " * 9), (None, "d e " * 9), (None, None)])
    assert periodic_runs(make_docs((1, "a")).filter("doc_id > 1")).collect() == []


def test_long_text(make_docs):
    rng = random.Random(9)
    words = [str(rng.randrange(2000)) for _ in range(60_000)]
    words[20_000:20_000] = words[5_000:7_000] * 5
    words += ["echo"] * 30_000
    got = periodic_runs(make_docs((3, " ".join(words)))).first()
    runs = [tuple(r) for r in got.runs]
    assert any(length >= 10_000 and q == 2000 for _, length, q in runs)
    assert (len(words) - 30_000, 30_000, 1) in runs
    assert got.collapsed.split(" ")[-2:] != ["echo", "echo"]
