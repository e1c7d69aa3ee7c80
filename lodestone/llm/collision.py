"""Nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on random directions; for each direction the projections are sorted. A query
opens, in every array, a window centred on its own projection; windows widen together by virtual
rehashing (the radius is multiplied, nothing is hashed anew). A vector that lies in the windows of enough
directions has collided often enough to be verified: its exact distance is computed once. A query stops
when its k-th verified distance, one for each id, is within what the windows at that radius have settled, and
at the latest when the windows hold everything, so no candidate is capped and copies take no places.

Vectors are dealt into blocks by hash and each block keeps its own sorted arrays, so that collisions of a
vector are counted where it stands, and none is shuffled. A fixed set of queries is dealt into blocks too,
and each pair of blocks is one task, whose k best go on to one ranking per query. Sorting a block's arrays
costs a small part of what searching it for a block of queries does. The work is the product of both
tables' rows times the share of entries that windows open: on vectors without any clusters (all about
equally far) windows must open four fifths of the entries to hold the nearest; the threshold then leaves
one vector in six to be verified, with a recall of 0.95.

Index sample: none; directions are random and every row is indexed. Cases: vectors that are null, zero,
empty or hold a null or non-finite component take no part, neither as query nor as candidate; vectors of
another dimension are candidates only among themselves; a row with a query's id is the query's own and no
candidate of it, and of query rows that repeat an id the least vector asks; of candidate rows that repeat
an id the nearest counts; null ids take no part; ties go to the smaller id; distances beyond the range of
a double are infinite; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Directions, and share of them in which a vector must collide.
DIRECTIONS, THRESHOLD = 120, 0.865
#: Factors of a step of the radius: while nothing is verified, and from then on.
STEP, FINE_STEP = 1.25, 1.06
#: Window half-width, in units of the radius: a vector at the radius' distance collides in 89 % of the directions, one 1.27 times as far in 79 %.
WIDTH = 1.6
#: Vectors with larger components are scaled down for the search.
LARGE = 1e100
#: Rows of a block of vectors, and of queries.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 2_048


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projections of a block of vectors; of rows that share an id (default: none do) the nearest counts."""

    def __init__(self, vectors: np.ndarray, directions: int, seed: int = 11, ids: np.ndarray | None = None):
        self.vectors = vectors
        self.number = np.arange(len(vectors)) if ids is None else np.unique(ids, return_inverse=True)[1]
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], directions))
        p = vectors @ self.axes
        order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, 0).T)  # a row for each direction
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        # a first radius: far below the spread of the projections
        self.radius = float(np.median(np.abs(p - np.median(p, 0)))) / 8 + 1e-12
        self.verified = self.opened = 0

    def nearest(self, query: np.ndarray, k: int, skip: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the rows other than skip that are as near as the k-th nearest id found (with all ties)."""
        m, n = self.order.shape
        counts, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        seen[skip] = True
        centre, radius = query @ self.axes, self.radius
        lo = [int(np.searchsorted(row, c)) for row, c in zip(self.sorted, centre)]
        hi = list(lo)
        places, distances = [np.zeros(0, np.int64)], [np.zeros(0)]
        enough = int(np.ceil(threshold * m))
        least = np.full(n, np.inf)
        while True:
            fresh = []
            for j, (row, c) in enumerate(zip(self.sorted, centre)):
                a, b = row.searchsorted(c - WIDTH * radius, "left"), row.searchsorted(c + WIDTH * radius, "right")
                if a < lo[j]:
                    fresh.append(self.order[j, a : lo[j]])
                    lo[j] = int(a)
                if b > hi[j]:
                    fresh.append(self.order[j, hi[j] : b])
                    hi[j] = int(b)
            if fresh:
                entries = np.concatenate(fresh)
                self.opened += len(entries)
                counts += np.bincount(entries, minlength=n)
            new = np.flatnonzero((counts >= enough) & ~seen)
            if len(new):
                seen[new] = True
                self.verified += len(new)
                d = self.vectors[new] - query
                places.append(new)
                distances.append(np.sqrt((d * d).sum(1)))
                np.minimum.at(least, self.number[new], distances[-1])
            met = least[np.isfinite(least)]
            everything = not any(lo) and min(hi) == n
            if everything or len(met) >= k and np.partition(met, k - 1)[k - 1] <= radius:
                break
            radius *= FINE_STEP if len(met) else STEP
        at, found = np.concatenate(places), np.concatenate(distances)
        if len(met) > k:
            keep = found <= np.partition(met, k - 1)[k - 1]
            at, found = at[keep], found[keep]
        return at, found


FOUND = "query_id bigint, vec_id bigint, score double"


def pair_of_blocks(k: int, directions: int) -> Callable:
    """One block of vectors searched for one block of queries."""

    def run(group: pa.Table) -> pa.Table:
        ids, asks = group.column("id").to_numpy(), group.column("ask").to_numpy(zero_copy_only=False)
        vectors = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        largest = float(np.abs(vectors).max(initial=0.0))
        scale = largest if largest > LARGE else 1.0
        vectors = vectors / scale if scale > 1 else vectors
        pool, out = np.flatnonzero(~asks), ([], [], [])
        if len(pool) and asks.any():
            index, own = Index(vectors[pool], directions, ids=ids[pool]), ids[pool]
            for q in np.flatnonzero(asks):
                at, distance = index.nearest(vectors[q], k, np.flatnonzero(own == ids[q]))
                order = np.lexsort((own[at], distance))
                # k different ids, however often their rows repeat
                _, firsts = np.unique(own[at][order], return_index=True)
                order = order[np.sort(firsts)][:k]
                for c, v in zip(out, (np.full(len(order), ids[q]), own[at][order], distance[order] * scale)):
                    c.append(v)
        column = lambda c, t: pa.array(np.concatenate(c) if c else [], t)
        return pa.table({"query_id": column(out[0], pa.int64()), "vec_id": column(out[1], pa.int64()), "score": column(out[2], pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", directions: int = DIRECTIONS, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each query."""
    shaped = lambda t: t.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    pool = shaped(vectors).withColumn("ask", F.lit(False))
    asks = shaped(queries).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("ask", F.lit(True))
    n, q = pool.count(), asks.count()
    vb, qb = max(1, -(-n // vector_block)), max(1, -(-q // query_block))
    spread = lambda c, parts, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = pool.withColumn("vb", spread("id", vb, 1)).withColumn("qb", each(qb)).unionByName(asks.withColumn("qb", spread("id", qb, 2)).withColumn("vb", each(vb)))
    found = dealt.withColumn("dim", F.size("vector")).groupBy("vb", "qb", "dim").applyInArrow(pair_of_blocks(k, directions), FOUND)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_query(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    rows = vectors.select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0))
