import math
import random

import duckdb
from pyspark.sql import functions as F

from querylume.llm import maxscore
from querylume.llm.queries import ORACLES, op10_maxscore


def slow(rows, k=5):
    whole = {}
    for i, (vec_id, x) in enumerate(rows):
        if vec_id is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            whole[i] = (vec_id, [math.floor(256 * v) for v in x])
    out = []
    for q in sorted({v for v, _ in whole.values() if v % 3 == 0}):
        query = next(w for v, w in whole.values() if v == q)
        sums = ((sum(a * b for a, b in zip(query, w)), v) for v, w in whole.values() if v != q)
        scored = sorted((-max(-2**63, min(2**63 - 1, s)), v) for s, v in sums)
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])]
    return out


def got(spark, rows, k=5):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame = frame.select("*", *(F.lit(0).alias(c) for c in ("shard", "ids", "weights", "score", "rank")))
    return sorted(tuple(r) for r in maxscore.top_k(frame, F.col("vec_id") % 3 == 0, k).collect())


def test_against_all_scores(spark, monkeypatch):
    rng = random.Random(1)
    near = [0.5, -0.25, 0.125]
    rows = [(i, [rng.choice(near) if rng.random() < 0.3 else rng.gauss(0, 0.2) for _ in range(12)])
            for i in range(700)]
    rows += [(1000 + i, [0.5] * 12) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf"), 1.0]),
             (2004, []), (2005, [0.9, 0.9]), (None, [3.0] * 12), (2007, [0.7] * 15), (2008, [0.0] * 12),
             (2010, [0.25] * 12)]
    rng.shuffle(rows)
    want = slow(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 25)
    assert got(spark, rows) == want


def test_blocks_within_a_shard():
    rng = random.Random(2)
    import numpy as np
    weights = np.floor(256 * np.array([[rng.gauss(0, 0.3) * 2 ** -(j / 4) for j in range(20)] for _ in range(9000)]))
    shard = maxscore.Shard(np.arange(9000), weights)
    for q in range(0, 9000, 500):
        scores = weights @ weights[q]
        order = [i for i in np.lexsort((np.arange(9000), -scores)) if i != q][:5]
        ids, best = shard.top(q, weights[q], 5)
        assert ids.tolist() == order and best.tolist() == scores[order].tolist()


def test_few_or_no_vectors(spark):
    assert got(spark, []) == []
    assert got(spark, [(3, [1.0])]) == []
    assert got(spark, [(3, [1.0]), (6, [2.0]), (7, [2.0])]) == slow([(3, [1.0]), (6, [2.0]), (7, [2.0])])
    assert got(spark, [(3, [1.0]), (4, [1.0]), (4, [1.0])]) == [(3, 1, 4, 65536), (3, 2, 4, 65536)]


def test_repeated_queries_against_the_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(1, 50)]
    for i in range(50, 1050, 50):
        usable = [rng.gauss(0, 0.3) for _ in range(6)]
        rows += [(i, None), (i, [None] * 6), (i, [float("nan")] * 6), (i, usable)]
        rows += [(i, usable)] * (i % 200 == 0) + [(i, usable[::-1])] * (i % 300 == 0)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = con.execute(ORACLES["op10_maxscore"]).fetchall()
    assert sorted(map(tuple, op10_maxscore(spark, str(tmp_path)).collect())) == sorted(want)


def test_large_components_are_exact(spark, monkeypatch):
    """One large value, many, and sums beyond 64 bits; ordinary vectors beside them."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(300, [1.0e6] + [0.5] * 7), (301, [-3.0e7] + [0.25] * 7)]
    assert got(spark, rows) == slow(as_floats(rows))
    rows += [(400 + i, [rng.choice([-1, 1]) * 2.0 ** rng.randrange(10, 21) for _ in range(8)]) for i in range(60)]
    assert got(spark, rows) == slow(as_floats(rows))
    vast = rows + [(500 + i, [2.0 ** rng.randrange(60, 100)] * 8) for i in range(6)]
    want = slow(as_floats(vast))
    assert got(spark, vast) == want
    monkeypatch.setattr(maxscore, "SHARD_BYTES", 8 * 8 * 50)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 9)
    monkeypatch.setattr(maxscore, "BLOCKS_EACH", 2)
    assert got(spark, vast) == want


def as_floats(rows):
    import numpy as np
    return [(i, [float(np.float32(v)) for v in x]) for i, x in rows]


def test_large_components_against_the_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(1, 400)] + [(1000, [1.0e6] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = con.execute(ORACLES["op10_maxscore"]).fetchall()
    assert sorted(map(tuple, op10_maxscore(spark, str(tmp_path)).collect())) == sorted(want)


def test_groups_are_dealt_evenly(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(1000)]
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 20)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 10)
    seen = []
    real = spark.range(0).repartitionById.__func__

    def watched(self, parts, key):
        out = real(self, parts, key)
        seen.append([r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()])
        return out
    monkeypatch.setattr(type(spark.range(0)), "repartitionById", watched)
    assert got(spark, rows) == slow(as_floats(rows))
    assert len(seen[0]) >= 50 and max(seen[0]) <= 2 * sorted(seen[0])[len(seen[0]) // 2]
