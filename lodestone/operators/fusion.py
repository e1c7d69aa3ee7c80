"""Fusion of dense and sparse rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import EngineConfig
from lodestone.operators.sparse import ranked


def fuse(dense: DataFrame, sparse: DataFrame, k: int, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(query_id, key, score, rank): the k best of both candidate lists of each query.

    Sparse scores are divided by the query's best one among its candidates. Where nothing is sparse, the
    dense score stands; where nothing is dense, the sparse one; else the two are blended, and never below
    the dense score. Scores have 6 decimals before any threshold sees them.
    """
    weight = min(1.0, max(0.0, cfg.dense_weight))
    per_query = Window.partitionBy("query_id")
    one = dense.select("query_id", "key", F.col("score").alias("d")).join(sparse.select("query_id", "key", F.col("score").alias("s")), ["query_id", "key"], "full")
    one = one.withColumn("top", F.coalesce(F.max("s").over(per_query), F.lit(0.0))).withColumn("has_dense", F.max(F.col("d").isNotNull()).over(per_query))
    d, s = F.coalesce("d", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    blend = weight * d + (1 - weight) * s / F.col("top")
    score = F.when(F.col("top") <= 0, d).when(~F.col("has_dense"), s / F.col("top")).otherwise(F.greatest(d, blend))
    return ranked(one.select("query_id", "key", F.round(score, 6).alias("score")), "query_id", F.col("score"), F.col("key"), k)


def reciprocal_ranks(rankings: DataFrame, k: int | None = None, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(query_id, key, rrf, score, rank) of rankings (query_id, key, rank, score) from several lists.

    Reciprocal ranks add up; the best raw score is kept, for the thresholds, and decides ties.
    """
    one = rankings.groupBy("query_id", "key").agg(F.round(F.sum(1 / (cfg.rrf_k + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc("score"), "key")
    out = one.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def collapse(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """(query_id, by, score, matched_on): of the rows of each key the first of best score."""
    return rows.groupBy("query_id", by).agg(F.max("score").alias("score"), F.max_by(kind, F.struct(F.col("score"), -F.col("rank"))).alias("matched_on"))
