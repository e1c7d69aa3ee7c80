"""BM25 as tables: postings that are written once, statistics derived from them, and scores of blocks of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import EngineConfig
from lodestone.functions import text as tx
from lodestone.sources import scratch

#: Postings of a block of documents, and weights of a block of queries.
POSTINGS, WEIGHTS = 1 << 19, 1 << 16


@dataclass(frozen=True)
class SparseIndex:
    """postings (key, dl, term, tf, head), terms (term, df, idf), and the corpus: number and mean length of documents.

    A document's first posting is its head; one without words has a head without a term.
    """

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings of documents; every row is one document.

    A document's words are sorted and counted in runs within its row, so nothing is shuffled.
    """
    words = tx.composed(scratch.spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))), "text")
    words = words.select("key", F.sort_array(tx.tokens(F.col("text"))).alias("ws"))
    new = lambda k: (k == 0) | (F.get("ws", k) != F.get("ws", k - 1))
    dl = F.size("ws")
    starts = words.select("key", "ws", dl.alias("dl"), F.when(dl > 0, F.filter(F.sequence(F.lit(0), dl - 1), new)).alias("starts"))
    runs = F.transform("starts", lambda a, k: F.struct(F.get("ws", a).alias("term"), (F.coalesce(F.get("starts", k + 1), F.col("dl")) - a).alias("tf")))
    return starts.select("key", "dl", F.posexplode_outer(runs).alias("at", "p")).select("key", "dl", "p.term", F.col("p.tf").cast("long").alias("tf"), (F.coalesce("at", F.lit(0)) == 0).alias("head"))


def index_of(posts: DataFrame, cfg: EngineConfig = EngineConfig()) -> SparseIndex:
    """Statistics of written postings. A negative idf becomes epsilon times the vocabulary's mean idf; documents without words count in n."""
    n, total = posts.where("head").agg(F.count(F.lit(1)), F.sum("dl")).first()
    counted = posts.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = scratch.written(counted.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    mean = terms.agg(F.avg("raw")).first()[0] or 0.0
    idf = F.when(F.col("raw") < 0, cfg.bm25_epsilon * mean).otherwise(F.col("raw"))
    return SparseIndex(posts, terms.select("term", "df", idf.alias("idf")), n, float(total or 0) / max(1, n))


def build(docs: DataFrame, key: str, text: str, cfg: EngineConfig = EngineConfig()) -> SparseIndex:
    """Index of documents: they are read and cut into words once, and their postings written."""
    return index_of(scratch.written(postings(docs, key, text), "postings"), cfg)


def ranked(df: DataFrame, by: str, score: Column, key: Column, k: int, name: str = "rank") -> DataFrame:
    """The k best rows of each group, best first, ties by key."""
    order = Window.partitionBy(by).orderBy(score.desc(), key)
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def rounded(x: np.ndarray) -> np.ndarray:
    """Numbers of 6 decimals, as Spark's round gives them: half up, by the shortest digits."""
    y = x * 1e6
    out = np.floor(y + 0.5) / 1e6
    for k in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-3):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different values of a column in order, nulls first, and each row's place among them."""
    d = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    order = pc.sort_indices(d.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return d.dictionary.take(order), place[d.indices.to_numpy()]


def _scored(avgdl: float, limit: int, cfg: EngineConfig) -> Callable:
    """Postings (key, dl, tf, tid) of whole documents and weights (query_id, wid, w) as the best documents of each query."""

    def run(posts: pa.Table, weights: pa.Table) -> pa.Table:
        tf, dl, tid = (posts.column(c).to_numpy() for c in ("tf", "dl", "tid"))
        keys, doc = _coded(posts.column("key"))
        part = tf * (cfg.bm25_k1 + 1) / (tf + cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * dl / avgdl))
        by = np.argsort(tid, kind="stable")
        tid, doc, part = tid[by], doc[by], part[by]
        names, query = _coded(weights.column("query_id"))
        by = np.lexsort((weights.column("wid").to_numpy(), query))
        query, term, w = query[by], weights.column("wid").to_numpy()[by], weights.column("w").to_numpy()[by]
        low, high = np.searchsorted(tid, term), np.searchsorted(tid, term, "right")
        cuts = np.searchsorted(query, np.arange(len(names) + 1))
        out: tuple[list, list, list] = [], [], []
        for q in range(len(names)):
            met = [k for k in range(cuts[q], cuts[q + 1]) if low[k] < high[k]]
            if not met:
                continue
            score = np.bincount(np.concatenate([doc[low[k] : high[k]] for k in met]), np.concatenate([w[k] * part[low[k] : high[k]] for k in met]), len(keys))
            at = np.flatnonzero(score > 0)
            if len(at) > limit:  # those that a rounding may lift to the last place stay
                at = at[score[at] >= np.partition(score[at], len(at) - limit)[len(at) - limit] - 2e-6]
            score = rounded(score[at])
            at, score = at[score > 0], score[score > 0]
            best = np.lexsort((at, -score))[:limit]
            for c, v in zip(out, (np.full(len(best), q), at[best], score[best])):
                c.append(v)
        join = lambda c, t: np.concatenate(c).astype(t) if c else np.empty(0, t)
        return pa.table({"query_id": names.take(pa.array(join(out[0], np.int64))), "key": keys.take(pa.array(join(out[1], np.int64))), "score": join(out[2], np.float64)})

    return run


def search(index: SparseIndex, queries: DataFrame, query_id: str, text: str, limit: int, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(query_id, key, score, rank): the best `limit` documents of each query, of those with a score over 0.

    A word that a query holds twice counts twice. Only postings of the queries' terms leave the join. They are
    dealt by document into blocks that meet the blocks of the queries' weights, and each block passes on the
    best `limit` documents of its queries only; so what is shuffled grows with the postings, not with documents times
    queries, though the work does. The number of blocks follows the rows.
    """
    asked = tx.composed(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text")), "text")
    asked = asked.select("query_id", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = scratch.written(asked, "asked")
    terms = scratch.written(index.terms.join(scratch.small(asked.select("term").distinct()), "term").withColumn("tid", F.monotonically_increasing_id()), "asked-terms")
    weights = asked.join(terms, "term").select("query_id", "tid", (F.col("qtf") * F.col("idf")).alias("w"))
    pb, qb = max(1, -(-(terms.agg(F.sum("df")).first()[0] or 0) // POSTINGS)), max(1, -(-asked.count() // WEIGHTS))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    posts = index.postings.join(scratch.small(terms.select("term", "tid")), "term").select("key", "dl", F.col("tf").cast("int").alias("tf"), "tid", block("key", pb).alias("pb"), each(qb).alias("qb"))
    weights = weights.select("query_id", F.col("tid").alias("wid"), "w", block("query_id", qb).alias("wb"), each(pb).alias("wp"))
    shape = f"query_id {asked.schema['query_id'].dataType.simpleString()}, key {index.postings.schema['key'].dataType.simpleString()}, score double"
    found = posts.groupBy("pb", "qb").cogroup(weights.groupBy("wp", "wb")).applyInArrow(_scored(index.avgdl, limit, cfg), shape)
    return ranked(found, "query_id", F.col("score"), F.col("key"), limit)
