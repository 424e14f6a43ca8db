import hashlib
import random

import pytest

from querylume.llm import suffix_dedup
from querylume.llm.suffix_dedup import repeated_spans, repeats, without_repeats


def slow(texts, n=200):
    """Removed bytes by looking up every string of n bytes."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for k, d in enumerate(data):
        for i in range(len(d) - n + 1):
            seen.setdefault(d[i:i + n], []).append((k, i))
    marked = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                marked[k][i:i + n] = b"\x01" * n
    out = []
    for d, m in zip(data, marked):
        kept = bytes(b for b, x in zip(d, m) if not x)
        runs = sum(x and not y for x, y in zip(m, b"\x00" + m))
        out.append((len(d), sum(m), runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return out


def check(make_docs, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts))
    docs = make_docs(*rows)
    want = [(i, *w[:4], None if t is None else w[4]) for (i, t), w in zip(rows, slow(texts))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, repeats(docs).collect()), key=key) == sorted(want, key=key)
    cleaned = without_repeats(docs)
    assert cleaned.columns == docs.columns
    got = [(r.doc_id, r.text) for r in cleaned.collect()]
    assert sorted(got, key=key) == sorted(((w[0], w[5]) for w in want), key=key)


def words(rng, n):
    return " ".join(rng.choice(["an", "thé", "or", "ing", "sh", "ñ", "ed"]) + rng.choice("abcdef") for _ in range(n))


def test_passages_copies_and_edits(make_docs):
    rng = random.Random(8)
    passages = [words(rng, rng.randrange(30, 120)) for _ in range(6)]
    texts = [None, "", "x", "short " * 20]
    for _ in range(50):
        parts = [words(rng, rng.randrange(2, 90))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages)[rng.randrange(40):], words(rng, rng.randrange(1, 60))]
        texts.append(" ".join(parts))
    for t in texts[10:30]:  # near copies: one to four changed bytes
        edited = bytearray(t, "utf-8")
        for _ in range(rng.randrange(1, 5)):
            edited[rng.randrange(len(edited))] = ord("#")
        texts.append(edited.decode(errors="replace"))
    texts += texts[5:9]
    check(make_docs, texts)


def test_lengths_around_the_limit(make_docs):
    rng = random.Random(2)
    texts = []
    for n in (198, 199, 200, 201, 202, 215, 216, 217, 230, 319, 320, 400):
        passage = "".join(rng.choice("abcdefgh") for _ in range(n))
        for _ in range(2):
            side = ["".join(rng.choice("uvwxyz") for _ in range(rng.randrange(150))) for _ in range(2)]
            texts.append(side[0] + "1" + passage + "2" + side[1])
    check(make_docs, texts)


@pytest.mark.parametrize("texts", [
    ["a" * 199, "a" * 200], ["a" * 201, "b" * 5000], ["ab" * 300, "ba" * 101, "abc" * 500],
    ["line of text that repeats\n" * 40, "line of text that repeats\n" * 9], ["é" * 100, "é" * 101, "xé" * 150],
    ["", None], [],
])
def test_periodic_and_tiny_texts(make_docs, texts):
    check(make_docs, texts) if texts else check(make_docs, [""])


def test_repeated_rows_and_ids(make_docs):
    rng = random.Random(3)
    a, b = words(rng, 100), words(rng, 100)
    c = words(rng, 20) + a[100:500] + words(rng, 9)
    check(make_docs, [a, a, b, c, words(rng, 80), None], [1, 1, 1, 2, None, None])
    single = words(rng, 300)
    check(make_docs, [single, c, words(rng, 50) + c[30:400]], [5, 6, 6])


def test_many_repeated_rows_share_one_list(make_docs):
    rng = random.Random(4)
    a, b = words(rng, 200), words(rng, 150)
    others = [a[:300] + "#" + a[301:], b, words(rng, 20) + b[100:500]]

    def held(texts, ids):
        docs = make_docs(*zip(ids, texts)).repartition(4)
        return {bytes(r.tk)[1:]: len(r.spans) for r in repeated_spans(docs).collect()}

    texts = [a] * 60 + others
    assert held(texts, [None] * 63) == held([a, a, *others], range(5))
    check(make_docs, texts, [None] * 60 + [7, 7, 8])


def test_long_text_in_segments(make_docs, monkeypatch):
    rng = random.Random(12)
    t = words(rng, 3000)
    texts = [t, words(rng, 400) + t[3000:5200] + words(rng, 200), t[9000:9900], "q" * 4000 + t[:600]]
    check(make_docs, texts)
    want = [x.tolist() for x in suffix_dedup.sample_texts([x.encode() for x in texts])]
    for n in (500, 777, 1900):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", n)
        assert [x.tolist() for x in suffix_dedup.sample_texts([x.encode() for x in texts])] == want


def colliding(rng):
    """Two different texts that Spark's ``hash`` does not tell apart: it takes four bytes at
    a time, and a change of one four is undone by the next."""
    def mix(k):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        return k * 0x1B873593 & 0xFFFFFFFF

    def unmix(k):
        k = k * pow(0x1B873593, -1, 1 << 32) & 0xFFFFFFFF
        k = (k >> 15 | k << 17) & 0xFFFFFFFF
        return k * pow(0xCC9E2D51, -1, 1 << 32) & 0xFFFFFFFF

    def step(h, k):
        h ^= mix(k)
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        return (h * 5 + 0xE6546B64) & 0xFFFFFFFF

    letters = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    while True:
        a, b, c = (bytes(rng.choice(letters) for _ in range(4)) for _ in range(3))
        h1, h2 = (step(42, int.from_bytes(x, "little")) for x in (a, b))
        second = unmix(mix(int.from_bytes(c, "little")) ^ h1 ^ h2).to_bytes(4, "little")
        if a != b and all(x in letters for x in second):
            return (a + c).decode(), (b + second).decode()


def test_texts_of_one_hash_stay_apart(spark, make_docs):
    rng = random.Random(11)
    one, two = colliding(rng)
    rest = words(rng, 70)[:352]
    first, second = one + rest, two + rest
    hashes = {r.h for r in make_docs(first, second).selectExpr("hash(text) AS h").collect()}
    assert len(hashes) == 1 and first != second
    check(make_docs, [first, second, rest[40:300], words(rng, 60)], [None, None, 5, -1])
    check(make_docs, [first, second, words(rng, 80), rest[:250]], [-1, None, -1, (1 << 63) - 1])
