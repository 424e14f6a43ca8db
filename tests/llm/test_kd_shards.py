import zlib
from collections import Counter, defaultdict

import pytest

from querylume.llm import kd_shards as kd
from querylume.llm.kd_shards import GROUP_SHARE, kd_shards


def check(rows, texts, n_shards):
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    of = dict(texts)
    sizes, slots = Counter(), defaultdict(list)
    groups = defaultdict(set)
    for r in rows:
        data = (of[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (
            len(data) + 8, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < n_shards
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[data].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [sizes[i] for i in range(n_shards)], groups


def test_sizes_are_near_equal(make_docs):
    texts = [(i, f"text {i} " * (1 + i * 7919 % 60)) for i in range(3000)]
    texts += [(3000 + i, "copy of a small group") for i in range(10)]
    texts += [(4000 + i, "one text held by a third of all rows " * 8) for i in range(1500)]
    sizes, groups = check(kd_shards(make_docs(*texts)).collect(), texts, 24)
    mean = sum(sizes) / 24
    assert max(sizes) <= mean * (1 + GROUP_SHARE) and min(sizes) >= mean * (1 - GROUP_SHARE)
    assert len(groups[b"copy of a small group"]) == 1


@pytest.mark.parametrize("texts", [
    [(0, None)], [(0, None), (1, ""), (2, "x")], [(i, "same") for i in range(50)],
    [(7, "same")] * 5 + [(None, "z" * 100_000)],
])
def test_odd_tables(make_docs, texts):
    rows = kd_shards(make_docs(*texts), 5).collect()
    assert len(rows) == len(texts)
    assert sum(r["size"] for r in rows) == sum(len(t or "") + 8 for _, t in texts)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_no_documents_and_null_metadata(spark, make_docs):
    assert kd_shards(make_docs("x").limit(0)).collect() == []
    bare = spark.sql("SELECT id AS doc_id, string(id) AS text, string(null) AS lang, string(null) AS source FROM range(40)")
    texts = [(i, str(i)) for i in range(40)]
    sizes, _ = check(kd_shards(bare, 4).collect(), texts, 4)
    assert max(sizes) - min(sizes) <= 40


def test_rows_without_an_id_are_dealt_too(make_docs):
    """A third of all rows hold one text and no doc_id, or all the same one."""
    for doc_id in (None, 7):
        texts = [(i, f"text {i} " * (1 + i * 7919 % 60)) for i in range(2000)]
        texts += [(doc_id, "one text held by a third of all rows " * 8)] * 1000
        rows = kd_shards(make_docs(*texts).repartition(4), 12).collect()
        assert len(rows) == 3000
        sizes, slots = Counter(), defaultdict(list)
        for r in rows:
            sizes[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
        mean = sum(sizes.values()) / 12
        assert len(sizes) == 12
        assert max(sizes.values()) <= mean * (1 + GROUP_SHARE) and min(sizes.values()) >= mean * (1 - GROUP_SHARE)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def slow_tree(units, n_shards):
    """Leaves of a K-d tree over (codes, bytes): every node is cut where the bytes below come
    nearest to its share, in its widest dimension, by looking at every place."""
    whole = [max(1, max(c[d] for c, _ in units) - min(c[d] for c, _ in units)) for d in range(4)]
    level, done = [(units, n_shards)], []
    while level:
        after = []
        # Widths are measured against the ranges of the whole table at each level.
        spans = [[(min(c[d] for c, _ in u), max(c[d] for c, _ in u)) for d in range(4)] for u, _ in level]
        whole = [max(1, max(s[d][1] for s in spans) - min(s[d][0] for s in spans)) for d in range(4)]
        for (held, k), span in zip(level, spans):
            if k == 1:
                after.append((held, 1))
                continue
            d = max(range(4), key=lambda x: ((span[x][1] - span[x][0]) / whole[x], -x))
            ordered = sorted(held, key=lambda u: u[0][d])
            wanted = sum(b for _, b in held) * (k // 2) / k
            sums = [0]
            for _, b in ordered:
                sums.append(sums[-1] + b)
            cut = min(range(len(sums)), key=lambda i: abs(sums[i] - wanted))
            after += [(ordered[:cut], k // 2), (ordered[cut:], k - k // 2)]
        level, done = ([], after) if all(k == 1 for _, k in after) else (after, done)
    return [{c for c, _ in held} for held, _ in done]


def test_cuts_are_those_of_a_slow_tree(spark, make_docs, monkeypatch):
    """Medians by histograms, to the last unit, against a tree that sorts every node."""
    monkeypatch.setattr(kd, "NEAR", 0)
    texts = [(i, f"text {i * 31 % 977} " * (1 + i * 7919 % 40)) for i in range(400)]
    docs = make_docs(*texts)
    for n_shards in (2, 3, 7, 12):
        units, shares = kd._units(kd._with_pieces(kd._metadata(docs), 1 << 40)).cache(), [n_shards]
        given = [(tuple(r[f"code{i}"] for i in range(4)), r["bytes"]) for r in units.collect()]
        while max(shares) > 1:
            units, shares = kd._split(units, shares, n_shards)
        got = defaultdict(set)
        for r in units.collect():
            got[r["node"]].add(tuple(r[f"code{i}"] for i in range(4)))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, slow_tree(given, n_shards)))
