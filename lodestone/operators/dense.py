"""Exact dense search: blocks of vectors against blocks of queries, each pair one matrix product."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.sparse import ranked

#: Rows of a block of vectors, of a block of queries, and queries whose scores are held at a time.
VECTOR_BLOCK, QUERY_BLOCK, AT_ONCE = 65_536, 2_048, 64


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, best first, ties to the earlier place."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.argsort(-score[at], kind="stable")[:k]]


def _product(k: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        keys, asks = group.column("key").to_numpy(), group.column("ask").to_numpy(zero_copy_only=False)
        flat = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(keys), -1)
        pool, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        pool = pool[np.argsort(keys[pool], kind="stable")]
        known, names, out = vectors[pool], keys[pool], ([], [], [])
        for a in range(0, len(asked) if len(pool) else 0, AT_ONCE):
            some = asked[a : a + AT_ONCE]
            scores = np.round(np.clip(vectors[some] @ known.T, 0, 1), 6)
            for q, score in zip(some, scores):
                at = best(score, k)
                for c, v in zip(out, (np.full(len(at), keys[q]), names[at], score[at])):
                    c.append(v)
        join = lambda c, t: pa.array(np.concatenate(c) if c else [], t)
        return pa.table({"query_id": join(out[0], pa.int64()), "key": join(out[1], pa.int64()), "score": join(out[2], pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, key: str, query_id: str, vector: str, limit: int) -> DataFrame:
    """(query_id, key, score, rank): the best `limit` vectors of each query by clamped dot product of unit vectors.

    Scores have 6 decimals; ties go to the smaller key. Null vectors are left out; vectors of different
    sizes don't meet. The number of blocks follows the number of rows, so a task's memory does not grow with
    either table; as the search is exact, its work is the product of both tables' rows.
    """
    shaped = lambda t, k, ask: t.select(F.col(k).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.lit(ask).alias("ask")).where("vector is not null and key is not null")
    pool, asks = shaped(vectors, key, False), shaped(queries, query_id, True)
    vb, qb = max(1, -(-pool.count() // VECTOR_BLOCK)), max(1, -(-asks.count() // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = pool.withColumn("vb", block(vb)).withColumn("qb", each(qb)).unionByName(asks.withColumn("qb", block(qb)).withColumn("vb", each(vb)))
    found = dealt.withColumn("dim", F.size("vector")).groupBy("vb", "qb", "dim").applyInArrow(_product(limit), "query_id bigint, key bigint, score double")
    return ranked(found, "query_id", F.col("score"), F.col("key"), limit)
