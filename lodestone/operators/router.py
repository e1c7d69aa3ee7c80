"""Routing of queries: question bank, passages, both, or refusal, for a whole table of queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import EngineConfig
from lodestone.functions import text as tx


def within_margin(hits: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Hits of queries whose best hit reaches the question threshold, down to the margin below the best."""
    return _within(hits, cfg).where("accepted").drop("accepted")


def distinct_answers(hits: DataFrame, key: str, answer: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Hits without those whose answer is nearly one of a better hit that is kept.

    The choice is greedy, best first, so it is a fold over each query's candidates, which the search has
    bounded; it is not transitive.
    """
    item = F.struct((-F.col("score")).alias("s"), F.col(key).alias("key"), F.array_distinct(tx.tokens(F.col(answer))).alias("w"))
    same = lambda a, b: F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == 0) & (F.size(b) == 0)).otherwise(tx.jaccard(a, b) >= cfg.answer_jaccard)
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.filter("items", lambda x: F.lit(False))
    kept = F.aggregate("items", empty, lambda acc, x: F.when(F.exists(acc, lambda y: same(x["w"], y["w"])), acc).otherwise(F.array_append(acc, x)))
    return lists.select("query_id", F.explode(kept).alias("x")).select("query_id", F.col("x.key").alias(key), (-F.col("x.s")).alias("score"))


def adaptive_threshold(best: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """The bar for passages, eased a little where the best one falls just short of it."""
    base = cfg.vector_threshold
    if not cfg.adaptive:
        return F.lit(base)
    eased = F.greatest(F.lit(base * cfg.adaptive_ratio), F.least(F.lit(base), best * 0.97))
    return F.when(best.isNull() | (best >= base), F.lit(base)).otherwise(eased)


def blended_confidence(best: Column, gate: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """Confidence of accepted hits, with the gate's where it gave one."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(gate.isNull(), best).otherwise((1 - cfg.gate_weight) * best + cfg.gate_weight * gate)))


def _within(hits: DataFrame, cfg: EngineConfig) -> DataFrame:
    """hits with accepted: whether within_margin() keeps them."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    floor = F.greatest(best - cfg.question_margin, F.lit(cfg.question_threshold * cfg.floor_ratio))
    return hits.withColumn("accepted", (best >= cfg.question_threshold) & (F.col("score") >= F.round(floor, 6)))


def gated(hits: DataFrame, gate: DataFrame | None) -> DataFrame:
    """hits (with accepted) after the relevance gate (query_id, keep array or null, gate_confidence).

    A null keep means that the gate failed, and keeps all; an empty one rejects all; else the hits listed
    stay, in the order listed.
    """
    if gate is None:
        return hits.withColumn("gate_rank", F.lit(0)).withColumn("gate_confidence", F.lit(None).cast("double"))
    place = F.array_position("keep", F.col("key"))
    both = hits.join(gate, "query_id", "left").withColumn("accepted", F.col("accepted") & (F.col("keep").isNull() | (place > 0)))
    return both.withColumn("gate_rank", F.coalesce(place, F.lit(0))).withColumn("gate_confidence", F.when(F.col("keep").isNotNull(), F.col("gate_confidence"))).drop("keep")


def route(queries: DataFrame, question_hits: DataFrame, passage_hits: DataFrame, cfg: EngineConfig = EngineConfig(), gate: DataFrame | None = None) -> DataFrame:
    """(query_id, route, confidence, best_question, best_passage, threshold, qa_keys, chunk_keys) of every query.

    question_hits and passage_hits: (query_id, key, score); each is read once. Passages may have a place, which
    then orders them instead of the score. Refusals carry their three nearest misses.
    """
    listed = lambda s: F.transform(F.array_sort(F.collect_list(s)), lambda x: x["key"])
    order = (-F.col("score")).alias("s")
    nearest = F.slice(listed(F.struct(order, "key")), 1, 3)
    questions = gated(_within(question_hits, cfg), gate).groupBy("query_id").agg(
        F.max("score").alias("best_question"),
        nearest.alias("near_question"),
        F.max(F.when(F.col("accepted"), F.col("score"))).alias("best_accepted"),
        F.max(F.when(F.col("accepted"), F.col("gate_confidence"))).alias("gate"),
        listed(F.when(F.col("accepted"), F.struct("gate_rank", order, "key"))).alias("qa"),
    )
    bar = adaptive_threshold(F.max("score").over(Window.partitionBy("query_id")), cfg)
    turn = F.col("place").alias("s") if "place" in passage_hits.columns else order
    passages = passage_hits.withColumn("threshold", bar).groupBy("query_id").agg(
        F.max("score").alias("best_passage"),
        F.slice(listed(F.struct(turn, "key")), 1, 3).alias("near_passage"),
        F.first("threshold").alias("threshold"),
        listed(F.when(F.col("score") >= F.col("threshold"), F.struct(turn, "key"))).alias("chunks"),
    )
    q = queries.select("query_id").join(questions, "query_id", "left").join(passages, "query_id", "left")
    one = F.coalesce(F.size("qa") > 0, F.lit(False))
    first = F.when(one, blended_confidence(F.col("best_accepted"), F.col("gate"), cfg))
    sure = one & (F.lit(not cfg.hybrid) | (first >= cfg.hybrid_ceiling))
    two = ~sure & F.coalesce(F.size("chunks") > 0, F.lit(False))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    passage = clamp(F.col("best_passage"))
    route_ = F.when(sure | (one & ~two), "question_bank").when(one & two, "hybrid").when(two, "vector_rag").otherwise("refused")
    confidence = F.when(sure | (one & ~two), first).when(one & two, F.greatest(first, passage)).when(two, passage).otherwise(F.greatest(passage, clamp(F.col("best_question"))))
    none = F.array().cast(dict(passage_hits.dtypes)["key"].join(("array<", ">")))
    return q.select(
        "query_id",
        route_.alias("route"),
        F.round(confidence, 6).alias("confidence"),
        F.coalesce("best_question", F.lit(0.0)).alias("best_question"),
        F.coalesce("best_passage", F.lit(0.0)).alias("best_passage"),
        F.coalesce("threshold", F.lit(cfg.vector_threshold)).alias("threshold"),
        F.when(one, F.col("qa")).when(~one & ~two, F.col("near_question")).alias("qa_keys"),
        F.coalesce(F.when(two, F.col("chunks")).when(~one, F.col("near_passage")), none).alias("chunk_keys"),
    )


def needs_split(query: Column) -> Column:
    """Whether a query may hold several questions."""
    return (F.length(query) >= 80) | query.rlike(r"(?i) and | و |[?;؛؟]")


def distinct_phrasings(phrasings: DataFrame, by: list[str] | None = None, order="pos") -> DataFrame:
    """phrasings without those equal to an earlier one of their group but for case."""
    by = by or ["query_id"]
    w = Window.partitionBy(*by, tx.casefold(F.col("text"))).orderBy(order)
    return phrasings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def numbered(rows: DataFrame, column: str, most: int, by: list[str] | None = None) -> DataFrame:
    """rows with the column numbered from 0 in its own order within each group, the first `most` of them."""
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(column)
    return rows.withColumn(column, F.row_number().over(w) - 1).where(F.col(column) < most)


def reranked(hits: DataFrame, orders: DataFrame) -> DataFrame:
    """hits (query_id, key, place, …) in the order (query_id, order) that a model gave; keys it doesn't list go, and a query without a usable order stays as it was."""
    place = F.array_position("order", F.col("key"))
    both = hits.join(orders.select("query_id", "order"), "query_id", "left").withColumn("__at", F.coalesce(place, F.lit(0)))
    usable = F.max("__at").over(Window.partitionBy("query_id")) > 0
    both = both.withColumn("__usable", usable).where(~F.col("__usable") | (F.col("__at") > 0))
    return both.withColumn("place", F.when(F.col("__usable"), F.col("__at")).otherwise(F.col("place"))).drop("order", "__at", "__usable")
