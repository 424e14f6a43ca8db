import random

import numpy as np
import xxhash

from querylume.llm import graph, simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in lowered).split(" ") if w]
    shingles = [words[i:i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, radius=3):
    """Component of each fingerprint, by comparing all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def expected(rows):
    fps = {}
    for doc_id, text in rows:
        fps.setdefault(slow_fingerprint(text), []).append(doc_id)
    of = slow_groups(fps)
    least = {}
    for f, ids in fps.items():
        least[of[f]] = min([*ids, least.get(of[f], min(ids))])
    return sorted((i, f"{f:016x}", least[of[f]]) for f, ids in fps.items() for i in ids)


def got(docs):
    return sorted(tuple(r) for r in simhash.simhash_groups(docs).collect())


def test_all_pairs_of_a_small_corpus(make_docs):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "gámma", "delta", "eps", "zeta", "eta", "θ", "iota x"]
    texts = [None, "", " \n", "one", "one two", "ONE two", "one\ttwo\x0bthree\x0cfour", "a" * 50000]
    for _ in range(60):
        base = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 120))]
        texts.append(" ".join(base))
        if rng.random() < 0.6:
            base[rng.randrange(len(base))] = "changed"
            texts += [" ".join(base)] * rng.randrange(1, 3)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert got(make_docs(*rows)) == expected(rows)


def test_no_documents(make_docs):
    assert got(make_docs("x").limit(0)) == []


def test_links_across_tiles_join_what_all_pairs_join(spark):
    rng = random.Random(5)
    fps = {0}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(8):  # chains: each within the radius of the one before it
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(sorted(fps))]
    frame = spark.createDataFrame(signed, "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in simhash.near_groups(frame, tile=20).collect()}
    of = slow_groups(fps)
    position = {f: i for i, f in enumerate(sorted(fps))}
    assert found == {position[f]: position[of[f]] for f in fps}


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)] + [(5000, i) for i in range(2000, 2100)]
    rows = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert rows == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_of_one_id_and_one_short_hash_stay(make_docs):
    """Texts that a 32-bit hash does not tell apart, with one id or none, are two rows."""
    from tests.llm.test_suffix_dedup import colliding

    one, two = colliding(random.Random(3))
    rng = random.Random(8)
    far = [" ".join(f"{rng.random()}" for _ in range(40)) for _ in range(2)]
    for doc_id in (7, None, -1):
        docs = make_docs((doc_id, one), (doc_id, two), (9, far[0]), (None, far[1]))
        assert {r.h for r in docs.limit(2).selectExpr("hash(text) AS h").collect()} and len(
            {r.h for r in docs.filter(docs.text.isin(one, two)).selectExpr("hash(text) AS h").collect()}) == 1
        kept = simhash.one_of_each(docs, 3, 3).collect()
        assert sorted(r.text for r in kept) == sorted([one, two, *far])


def test_null_and_empty_texts_are_one_group(make_docs):
    docs = make_docs((1, None), (1, ""), (1, None), (2, " "))
    assert [tuple(r)[:2] for r in simhash.one_of_each(docs).collect()] == [(1, None)]
