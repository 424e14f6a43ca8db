import random

from pyspark.sql import functions as F

from querylume.llm import suffix_order
from tests.llm.test_suffix_dedup import slow, words


def removed(rows):
    """Bytes that spans cover, by key."""
    out = {}
    for r in rows:
        marked = out.setdefault((r.dk, bytes(r.tk)), set())
        for start, end in r.spans:
            marked.update(range(start, end))
    return out


def check(make_docs, texts, length):
    rows = suffix_order.repeated_spans(make_docs(*enumerate(texts)), length).collect()
    got = {dk: len(marked) for (dk, _), marked in removed(rows).items()}
    want = {i: w[1] for i, w in enumerate(slow(texts, length)) if w[1]}
    assert got == want


def test_passages_and_copies(make_docs):
    rng = random.Random(5)
    passage = words(rng, 20)
    texts = [None, "", "short", words(rng, 10)]
    texts += [words(rng, rng.randrange(8)) + passage[rng.randrange(40):] + words(rng, 4) for _ in range(4)]
    check(make_docs, [*texts, texts[4], "ab" * 40], 20)


def test_short_strings_of_few_letters(make_docs):
    rng = random.Random(3)
    check(make_docs, ["".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(3)]
          + ["".join(rng.choice("abcdefgh") for _ in range(25)) for _ in range(6)], 3)


def test_no_rows_and_repeated_rows(make_docs):
    docs = make_docs((1, "abcdefgh"), (1, "abcdefgh"), (None, "abcdefgh"), (2, "x"))
    assert suffix_order.repeated_spans(docs.filter(F.lit(False)), 3).count() == 0
    again = removed(suffix_order.repeated_spans(docs, 3).collect())
    assert {k[0]: len(v) for k, v in again.items()} == {1: 8, (1 << 63) - 1: 8}
