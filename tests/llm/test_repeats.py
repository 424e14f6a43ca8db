import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from querylume.llm import repeats, word_symbols
from querylume.llm.repeats import first_occurrences, samples_of, without_repeats


def slow(rows, n=20):
    """What is left of each row, by looking up every window in the order of the texts."""
    def place(row):
        doc_id, text = row
        return doc_id is None, doc_id or 0, hashlib.md5((text or "").encode()).digest()

    seen, kept = set(), {}
    for row in sorted(set(rows), key=place):
        words = (row[1] or "").encode().split()
        gone = set()
        for i in range(len(words) - n + 1):
            window = tuple(words[i:i + n])
            if window in seen:
                gone.update(range(i, i + n))
            seen.add(window)
        kept[row] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return [(r[0], *kept[r][:2], None if r[1] is None else kept[r][2]) for r in rows]


KEY = lambda r: tuple((x is None, x) for x in r)


def check(make_docs, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts))
    docs = make_docs(*rows).repartition(3)
    want = slow(rows)
    assert sorted(map(tuple, first_occurrences(docs).collect()), key=KEY) == sorted(want, key=KEY)
    return docs, want


def prose(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    passages = [prose(rng, rng.randrange(18, 90)) for _ in range(8)]
    out = [None, "", "x", "one two three"]
    for _ in range(70):
        parts = [prose(rng, rng.randrange(2, 70))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(passages).split()
            cut = rng.randrange(10)
            parts += [" ".join(words[cut:len(words) - rng.randrange(10)]), prose(rng, rng.randrange(1, 40))]
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    for t in out[10:30]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out + out[5:9] + ["again and again " * 30, "again and again " * 12, "line of words\n" * 60, "a " * 90]


def test_passages_copies_edits_and_periods(make_docs, texts):
    docs, want = check(make_docs, texts)
    cleaned = without_repeats(docs)
    assert cleaned.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=KEY)
    assert got == sorted(((w[0], w[3]) for w in want), key=KEY)


def test_few_different_words(make_docs):
    rng = random.Random(4)
    check(make_docs, [prose(rng, rng.randrange(120), kinds) for kinds in (1, 2, 3) for _ in range(25)])


def test_segments_cut_a_text_anywhere(make_docs, texts, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 500)
    check(make_docs, texts)


def test_ids_nulls_and_repeated_rows(make_docs):
    rng = random.Random(6)
    a, b = prose(rng, 100), prose(rng, 80)
    mix = prose(rng, 10) + " " + a[50:300] + " " + prose(rng, 10)
    check(make_docs, [a, a, b, mix, b, None, a, mix], [1, 1, 1, None, None, None, (1 << 63) - 1, -1])
    check(make_docs, [a] * 40 + [mix, b], [None] * 40 + [5, 5])


def test_no_rows(make_docs):
    assert first_occurrences(make_docs((1, "a")).filter("doc_id > 1")).collect() == []


WORDS = st.lists(st.integers(0, 3), min_size=1, max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_equal_windows_have_one_symbol(parts, left, right):
    """Whatever stands around a window, it is represented by the same symbol."""
    middle = [w for p in parts for w in p * 2][:40]
    names = np.array([5, 7, 11, 13], np.uint64) * word_symbols.ODD[0]
    n = min(8, len(middle))
    found = []
    for at, sequence in ((0, middle), (len(left), left + middle + right), (len(right), right + middle)):
        words = names[np.array(sequence)] | np.uint64(1)
        windows = at + np.arange(len(middle) - n + 1)
        name, place = word_symbols.anchors(words, n, windows)
        found.append((name.tolist(), (place - at).tolist()))
    assert found[0] == found[1] == found[2]


def test_every_window_meets_its_copies(texts):
    """Equal windows lie in samples of one name, at equal places before the symbol."""
    split = [(t or "").encode().split() for t in texts] + [("a b c d e f g h i j k " * 30).encode().split()]
    number, first, last, name, _ = samples_of(split)
    held = {}
    for k, lo, hi, symbol in zip(number.tolist(), first.tolist(), last.tolist(), name.tolist()):
        for at in range(lo, hi + 1):
            held.setdefault(tuple(split[k][at:at + 20]), set()).add(symbol)
    assert sum(len(t) - 19 for t in split if len(t) >= 20) >= len(held) > 1000
    assert all(len(symbols) == 1 for symbols in held.values())


def test_samples_are_sparse():
    rng = random.Random(2)
    texts = [prose(rng, 3000, 5000).encode().split() for _ in range(5)]
    number, first, last, _, _ = samples_of(texts)
    assert (last - first + 1).sum() == 5 * (3000 - 19)
    assert len(number) < 5 * 3000 / 6
