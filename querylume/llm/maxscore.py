"""Exact top-k by integer inner product with MaxScore.

A vector's components are the weights of its terms. In a shard every term has bounds on
what it can add to a query's score. Terms are taken by falling span of these bounds: the
essential ones, without which no candidate can reach the k-th best score so far, are
traversed for all candidates; the others are probed only for candidates that can still
get there. The best of every shard are merged.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from querylume.llm.common import written

K, SCALE = 5, 256
# Vectors of a shard and of a block of queries, and their bytes, whichever is reached first.
SHARD_ROWS, BLOCK_ROWS, QUERY_ROWS = 16384, 2048, 1024
SHARD_BYTES = 16 << 20
# Blocks of queries that one shard is sent for at a time.
BLOCKS_EACH = 8
PROBES = 8
# Sums below the first are exact as floats, below the second as integers of 64 bits. Vectors
# with a larger weight than ORDINARY are packed apart, so that they slow no others.
EXACT, LONG, ORDINARY = 1 << 53, 1 << 63, 1 << 19
PACKED = "shard long, ids binary, weights binary, n_terms int"
FOUND = "query_id long, vec_id long, score long"


def quantised(column):
    """Weights floor(SCALE * x) of an Arrow column of lists as a matrix, shorter lists
    padded with zeros, and which rows take part: those without a null or non-finite."""
    n = len(column)
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
    flat = column.flatten()  # skips null lists
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        x = SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = missing | ~np.isfinite(x)
    rows = np.repeat(np.arange(n), lengths)
    usable = column.is_valid().to_numpy(zero_copy_only=False).copy()
    usable[rows[bad]] = False
    weights = np.zeros((n, int(lengths.max(initial=0))))
    places = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weights[rows[~bad], places[~bad]] = np.floor(x[~bad])
    return weights[usable], usable


class _Pile:
    """Vectors gathered until they fill a shard."""

    def __init__(self, most):
        self.most, self.ids, self.weights = most, [], []

    def add(self, ids, weights):
        if len(ids):
            self.ids.append(ids)
            self.weights.append(weights)

    def shards(self, rest=False):
        """Full shards, with ``rest`` also what is left, as (ids, weights)."""
        if not self.ids:
            return
        width = max(w.shape[1] for w in self.weights)
        rows = max(1, min(self.most, SHARD_BYTES // (8 * max(1, width))))
        if not rest and sum(map(len, self.ids)) < rows:
            return
        matrix = np.concatenate([np.pad(w, ((0, 0), (0, width - w.shape[1]))) for w in self.weights])
        names = np.concatenate(self.ids)
        while len(names) >= rows or rest and len(names):
            yield names[:rows], matrix[:rows]
            names, matrix = names[rows:], matrix[rows:]
        self.ids, self.weights = [names], [matrix]


def _packing(rows_each):
    def pack(batches):
        piles, made = [_Pile(rows_each), _Pile(rows_each)], 0

        def packed(rest=False):
            nonlocal made
            for pile in piles:
                for names, matrix in pile.shards(rest):
                    shard = (TaskContext.get().partitionId() << 32) + made
                    made += 1
                    yield pa.RecordBatch.from_pydict({
                        "shard": [shard], "ids": [names.tobytes()], "weights": [matrix.tobytes()],
                        "n_terms": pa.array([matrix.shape[1]], pa.int32()),
                    })

        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            weights, usable = quantised(batch.column(1))
            ids = batch.column(0).to_numpy()[usable]
            large = np.abs(weights).max(axis=1, initial=0) > ORDINARY
            for pile, some in zip(piles, (~large, large)):
                pile.add(ids[some], weights[some])
            yield from packed()
        yield from packed(rest=True)
    return pack


def pack(vectors: DataFrame, rows_each) -> DataFrame:
    """Vectors (vec_id, embedding) as written rows of up to ``rows_each`` vectors."""
    shards = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(
        _packing(rows_each), PACKED)
    return written(shards, "vectors")


class Shard:
    """Vectors by term (one array per term), with each term's bounds; the weights are floats
    or integers of 64 bits, whichever hold every sum exactly."""

    def __init__(self, ids, weights):
        order = np.argsort(ids, kind="stable")
        self.ids, self.terms = ids[order], np.ascontiguousarray(weights[order].T)
        none = np.zeros(len(self.terms), self.terms.dtype)
        self.least = self.terms.min(axis=1) if len(ids) else none
        self.most = self.terms.max(axis=1) if len(ids) else none

    def top(self, query_id, query, k):
        """(ids, scores) of the k best, ties to smaller ids, without ``query_id``."""
        n, kind = min(len(query), len(self.terms)), self.terms.dtype
        query = query[:n].astype(kind)
        ends = np.stack([query * self.least[:n], query * self.most[:n]])
        low, span = ends.min(axis=0), np.ptp(ends, axis=0)
        order = np.argsort(-span, kind="stable")
        query = query[order]
        nothing = np.zeros(1, kind)
        # What the terms from each on can add at most, and what they add at least.
        rest_high = np.append(np.cumsum((low + span)[order][::-1])[::-1], nothing)
        floor = np.append(nothing, np.cumsum(low[order]))
        best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
        for start in range(0, len(self.ids), BLOCK_ROWS):
            ids = self.ids[start:start + BLOCK_ROWS]
            full = len(best) == k
            # Non-essential: the terms whose bounds together stay within reach of the k-th
            # score even if every essential term adds the least it can.
            within = floor + rest_high <= best[-1] if full else np.zeros(n + 1, bool)
            essential = int(np.argmax(within)) if within.any() else n
            if essential == 0 and n:
                continue
            at = np.arange(len(ids))
            scores = query[:essential] @ self.terms[order[:essential], start:start + BLOCK_ROWS]
            done = essential
            while True:
                # Ids rise, so a later candidate must beat the k-th score, not equal it.
                if full:
                    keep = scores + rest_high[done] > best[-1]
                    at, scores = at[keep], scores[keep]
                if done == n or not len(at):
                    break
                probed = order[done:done + PROBES]
                scores = scores + query[done:done + PROBES] @ self.terms[probed][:, start + at]
                done += len(probed)
            own = ids[at] != query_id
            best_ids = np.concatenate([best_ids, ids[at][own]])
            best = np.concatenate([best, scores[own]])
            first = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[first], best[first]
        return best_ids, best


class VastShard:
    """Vectors whose sums need more than 64 bits: whole numbers of any size, all scored. A
    score that a long cannot hold counts as the nearest one it can."""

    def __init__(self, ids, weights):
        self.ids, self.rows = ids.tolist(), [[int(x) for x in row] for row in weights.tolist()]

    def top(self, query_id, query, k):
        query = [int(x) for x in query.tolist()]
        sums = (sum(a * b for a, b in zip(query, row)) for row in self.rows)
        held = (min(max(s, -LONG), LONG - 1) for s in sums)
        first = sorted((-s, i) for s, i in zip(held, self.ids) if i != query_id)[:k]
        return np.array([i for _, i in first], np.int64), np.array([-s for s, _ in first], np.int64)


def _made(kinds, ids, weights, bound):
    """The shard in the cheapest form that is exact up to ``bound``, made once."""
    kind = 0 if bound < EXACT else 1 if bound < LONG else 2
    if kind not in kinds:
        kinds[kind] = VastShard(ids, weights) if kind == 2 else Shard(
            ids, weights if kind == 0 else weights.astype(np.int64))
    return kinds[kind]


def _searching(k):
    def search(batches):
        group = None
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                weights = np.frombuffer(row["weights"], np.float64).reshape(len(ids), row["n_terms"])
                if row["is_shard"]:
                    group, candidates, kinds = row["group"], (ids, weights), {}
                    largest = float(np.abs(weights).max(initial=0))
                    continue
                assert row["group"] == group
                terms = min(weights.shape[1], candidates[1].shape[1])
                bound = int(largest) * int(np.abs(weights).max(initial=0)) * max(1, terms)
                shard = _made(kinds, *candidates, bound)
                found = [(i, *shard.top(i, q, k)) for i, q in zip(ids.tolist(), weights)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat([i for i, _, _ in found], [len(x) for _, x, _ in found]).astype(np.int64),
                    "vec_id": np.concatenate([x for _, x, _ in found]),
                    "score": np.concatenate([s for _, _, s in found]).astype(np.int64),
                })
    return search


def _numbered(packed: DataFrame) -> DataFrame:
    """Packed rows with their number from 0; there is one for thousands of vectors."""
    number = F.row_number().over(Window.orderBy("shard")) - 1
    names = packed.select("shard", number.cast("long").alias("number"))
    return packed.join(names, "shard").select("number", "ids", "weights", "n_terms")


def top_k(vectors: DataFrame, is_query, k=K) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows of ``vectors`` (vec_id,
    embedding; more columns are ignored) that score best for each row with ``is_query``.

    Rows with a null vec_id, and vectors that are null or hold a null or non-finite
    component (or one whose SCALE-fold is not finite), take no part. Scores are exact
    whatever the size of the components; one beyond a long counts as the nearest long. A shorter vector counts as padded with zeros. Rows of the
    query's own vec_id are no candidates; other repeated rows count each. Every query row
    that takes part is searched; those that repeat a vec_id share its ranks, so that a
    candidate counts once for each of them. No rows, no rows.
    """
    chosen = vectors.select("vec_id", "embedding")
    shards = pack(chosen, SHARD_ROWS)
    # Dealt by place, so that blocks are full and rows of one vec_id are spread.
    asked = chosen.filter(is_query).withColumn("place", F.monotonically_increasing_id()).repartition("place")
    queries = pack(asked, QUERY_ROWS)
    # Every shard meets every block of queries. It is sent once for each BLOCKS_EACH of them:
    # such groups have a number, and numbers are dealt out evenly. A group's shard comes
    # first, and is turned once.
    n = max(1, shards.count())
    n_blocks = queries.count()
    sets = max(1, -(-n_blocks // BLOCKS_EACH))
    every = lambda end: F.explode(F.sequence(F.lit(0), F.lit(end - 1).cast("long")))
    sent = [
        _numbered(shards).withColumn("set", every(sets)).select(
            (F.col("number") * sets + F.col("set")).alias("group"), F.lit(True).alias("is_shard"),
            "ids", "weights", "n_terms"),
        _numbered(queries).withColumn("at", every(n)).select(
            (F.col("at") * sets + F.expr(f"number div {BLOCKS_EACH}")).alias("group"),
            F.lit(False).alias("is_shard"), "ids", "weights", "n_terms"),
    ]
    parts = min(n * sets, 20_000)
    dealt = sent[0].unionByName(sent[1]).repartitionById(parts, F.pmod("group", F.lit(parts)).cast("int"))
    found = dealt.sortWithinPartitions("group", F.desc("is_shard")).mapInArrow(_searching(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
