"""The engine's facade: ingest documents, answer tables of queries, browse and edit the bank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import models, schemas
from lodestone.config import EngineConfig
from lodestone.functions import text as tx
from lodestone.operators import answers, bank, chunker, dense, fusion, grounding, pages, records, router, sparse
from lodestone.sources import files, scratch
from lodestone.sources.store import Store, new_only


@dataclass(frozen=True)
class Steps:
    """Model-backed steps of a search; each is a plan over tables, and None leaves it out.

    split: (query_id, query) -> (query_id, pos, text), parts of queries that may hold several questions;
    expand: (query_id, pos, text) -> (query_id, pos, n, text), other phrasings of each part;
    gate: (query_id, key, score, question) -> (query_id, keep, gate_confidence), see router.gated();
    rerank: (query_id, key, score, place, text), (query_id, query) -> (query_id, order), keys best first.
    A query without rows in what a step gives is one for which the step failed: it goes on as it was.
    """

    split: Callable[[DataFrame], DataFrame] | None = None
    expand: Callable[[DataFrame], DataFrame] | None = None
    gate: Callable[[DataFrame], DataFrame] | None = None
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None


class Engine:
    """Tables in a store, and the plans over them. Every method takes and gives DataFrames."""

    def __init__(self, spark: SparkSession, root: str, cfg: EngineConfig = EngineConfig(), embedder: models.Embedder | None = None, steps: Steps = Steps()):
        self.spark, self.cfg, self.store, self.steps = spark, cfg, Store(spark, root), steps
        self.embedder = embedder or models.HashEmbedder()
        #: One row on the last ingest's extraction; see records.coverage().
        self.last_coverage: DataFrame | None = None

    def chunks(self) -> DataFrame:
        return self.store.read("chunks", schemas.CHUNKS)

    def pairs(self) -> DataFrame:
        return self.store.read("qa_pairs", schemas.QA_PAIRS)

    def analyze(self, pages_: DataFrame, mode: str = "auto", force: bool = False) -> DataFrame:
        """What ingest would do with each page."""
        return pages.report(pages_, self.cfg, mode, force)

    def ingest(self, pages_: DataFrame, force: bool = False, extract=models.sentence_extractor, fingerprint: str = "", across=None) -> dict[str, int]:
        """Clean, chunk and mine documents that aren't indexed yet (force: all), and publish them at once.

        extract: (chunk_id, text, prev_text, next_text) -> raw pairs, with an error column or without; what it
        gave for a chunk is kept under a digest of the chunk and the fingerprint of the extractor, and it isn't
        asked again. across: (doc_id, ordinal, chunk_id, first, second) -> raw pairs that need two chunks.
        """
        fresh = pages_ if force else new_only(pages_, self.chunks(), self.pairs())
        table = scratch.written(chunker.chunk_table(pages.clean(fresh), self.cfg), "chunks")
        children = table.where("chunk_kind = 'child'")
        asked = chunker.neighbours(children, "doc_id", "ordinal", "text").where(F.length(tx.strip(F.col("text"))) >= self.cfg.qa_min_chunk)
        asked = asked.withColumn("digest", files.cache_key(F.col("doc_id"), F.col("ordinal"), F.col("text"), fingerprint=fingerprint))
        cached = self.store.read("extractions", f"digest string, {models.RAW}")
        misses = asked.join(cached.select("digest").distinct(), "digest", "left_anti")
        got = scratch.written(models.complete(extract(misses)).join(misses.select("chunk_id", "digest"), "chunk_id"), "raw")
        raw = got.unionByName(cached.join(asked.select("digest", F.col("chunk_id").alias("own")), "digest").withColumn("chunk_id", F.col("own")).drop("own"))
        raw = scratch.written(raw.where("question is not null or error is not null"), "raw")
        mined = raw.where("error is null").drop("error", "digest")
        if across is not None:
            two = chunker.adjacent_pairs(children, "doc_id", "ordinal", "text").join(children.select("doc_id", "ordinal", "chunk_id"), ["doc_id", "ordinal"])
            kind = F.when(F.col("question_type").isin("multi_hop", "comparative", "critical"), F.col("question_type")).otherwise(F.lit("multi_hop"))
            mined = mined.unionByName(models.complete(across(two)).where("error is null and question is not null").drop("error").withColumn("question_type", kind).withColumn("pos", F.col("pos") + 1000))
        pairs = grounding.validate(mined, children, self.cfg)
        pairs = scratch.written(grounding.merge_longest(pairs, "question", "answer", ["chunk_id", "pos"]), "pairs")
        self.last_coverage = records.coverage(asked, raw, pairs)
        columns = [c.split()[0] for c in schemas.QA_PAIRS.split(", ")]
        chunks = table.select(*(c.split()[0] for c in schemas.CHUNKS.split(", ")))
        index = sparse.postings(children, "chunk_id", "text").join(children.select(F.col("chunk_id").alias("key"), "doc_id"), "key")
        vectors = models.embed(children.select("doc_id", "chunk_id", "text"), "text", "vector", self.embedder).drop("text")
        made = {"chunks": (chunks, "doc_id"), "qa_pairs": (pairs.select(*columns), "doc_id" if force else "qa_id"), "chunk_postings": (index, "doc_id"), "chunk_vectors": (vectors, "doc_id")}
        self.store.upsert_all(made | {"extractions": (got.where("error is null").select("digest", *(c.split()[0] for c in models.RAW.split(", "))), "digest")})
        return self.stats()

    def search_questions(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, score, rank, matched_on): best questions of each query (query_id, query)."""
        cfg, pairs = self.cfg, self.pairs()
        rows = bank.search_rows(pairs).withColumn("row", F.xxhash64("row_id"))
        near = dense.search(models.embed(rows, "text", "vector", self.embedder), self._asked(queries), "row", "qn", "vector", cfg.overfetch * cfg.question_k)
        near = near.join(rows.select(F.col("row").alias("key"), "qa_id", "row_kind"), "key")
        best = fusion.collapse(near, "qa_id", "row_kind")
        best = best.join(self._numbers(queries), best["query_id"] == F.col("qn")).select(F.col("id").alias("query_id"), F.col("qa_id").alias("key"), "score", "matched_on")
        words = sparse.search(sparse.build(bank.sparse_text(pairs), "qa_id", "text", cfg), queries, "query_id", "query", cfg.overfetch * cfg.question_k, cfg)
        out = fusion.fuse(best, words, cfg.question_k, cfg)
        return out.join(best.select("query_id", "key", "matched_on"), ["query_id", "key"], "left").withColumn("matched_on", F.coalesce("matched_on", F.lit("question")))

    def search_chunks(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, score, rank, text): best child chunks of each query, with their parents' text."""
        cfg, table = self.cfg, self.chunks()
        children = table.where("chunk_kind <> 'parent'").withColumn("row", F.xxhash64("chunk_id"))
        vectors = self.store.read("chunk_vectors", "doc_id string, chunk_id string, vector array<double>").withColumn("row", F.xxhash64("chunk_id"))
        near = dense.search(vectors, self._asked(queries), "row", "qn", "vector", cfg.overfetch * cfg.vector_k)
        near = near.join(children.select(F.col("row").alias("key"), "chunk_id"), "key").join(self._numbers(queries), F.col("query_id") == F.col("qn")).select(F.col("id").alias("query_id"), F.col("chunk_id").alias("key"), "score")
        words = sparse.search(self._chunk_index(), queries, "query_id", "query", cfg.overfetch * cfg.vector_k, cfg)
        hits = fusion.fuse(near, words, cfg.vector_k, cfg)
        above = table.where("chunk_kind = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
        shown = children.join(above, "parent_id", "left").select(F.col("chunk_id").alias("key"), F.coalesce(F.nullif("parent_text", F.lit("")), F.col("text")).alias("text"))
        return hits.join(shown, "key")

    def phrasings(self, queries: DataFrame) -> DataFrame:
        """(query_id, pos, n, text): each query's parts (three at most), and of each part the text and its rewrites (three at most)."""
        parts = queries.select("query_id", F.lit(0).alias("pos"), tx.strip(F.col("query")).alias("text"))
        if self.steps.split:
            asked = queries.where(router.needs_split(F.col("query")))
            got = self.steps.split(asked).select("query_id", "pos", tx.strip(F.col("text")).alias("text")).where("text <> ''")
            got = router.numbered(router.distinct_phrasings(got), "pos", 3)
            parts = parts.join(got.select("query_id").distinct(), "query_id", "left_anti").unionByName(got)
        all_ = parts.select("query_id", "pos", F.lit(0).alias("n"), "text")
        if self.steps.expand:
            more = self.steps.expand(parts).select("query_id", "pos", F.col("n").cast("int").alias("n"), tx.strip(F.col("text")).alias("text")).where("text <> ''").withColumn("n", F.col("n") + 1)
            per_part = ["query_id", "pos"]
            all_ = router.numbered(router.distinct_phrasings(all_.unionByName(more), per_part, "n"), "n", 4, per_part)
        return router.distinct_phrasings(all_, ["query_id"], F.struct("pos", "n"))

    def search_phrasings(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, score, place, text): chunks found by each phrasing of a query, fused by reciprocal ranks, cut, and reranked."""
        cfg = self.cfg
        asked = self.phrasings(queries)
        if not (self.steps.split or self.steps.expand):
            fused = self.search_chunks(queries).withColumnRenamed("rank", "place")
        else:
            named = scratch.written(asked.withColumn("phrasing", F.concat_ws("#", F.xxhash64("query_id"), "pos", "n")), "phrasings")
            hits = scratch.written(self.search_chunks(named.select(F.col("phrasing").alias("query_id"), F.col("text").alias("query"))), "hits")
            each = hits.join(named.select(F.col("query_id").alias("id"), F.col("phrasing").alias("query_id")), "query_id")
            texts = hits.select("key", "text").dropDuplicates(["key"])
            best = fusion.reciprocal_ranks(each.select(F.col("id").alias("query_id"), "key", "rank", "score"), max(cfg.vector_k, 8), cfg)
            fused = best.select("query_id", "key", "score", F.col("rank").alias("place")).join(texts, "key")
        fused = fused.select("query_id", "key", "score", "place", "text")
        return router.reranked(fused, self.steps.rerank(fused, queries)) if self.steps.rerank else fused

    def route(self, queries: DataFrame) -> DataFrame:
        """The outcome of each query; blank queries are refused without a search."""
        real = tx.composed(queries.where(tx.strip(tx.text_or_empty(F.col("query"))) != ""), "query")
        pairs = self.pairs()
        questions = scratch.written(self.search_questions(real), "questions")
        accepted = router.within_margin(questions, self.cfg)
        kept = router.distinct_answers(accepted.join(pairs.select(F.col("qa_id").alias("key"), "answer"), "key"), "key", "answer", self.cfg)
        gate = self.steps.gate(kept.join(pairs.select(F.col("qa_id").alias("key"), "question"), "key")) if self.steps.gate else None
        other = questions.join(accepted.select("query_id", "key"), ["query_id", "key"], "left_anti").select("query_id", "key", "score")
        return router.route(queries, kept.select("query_id", "key", "score").unionByName(other), self.search_phrasings(real), self.cfg, gate)

    def ask(self, queries: DataFrame, generate=models.extractive_answer, audit=models.containment_audit) -> DataFrame:
        """Answers with citations, near misses and notes for each query (query_id, query).

        audit: (query_id, text), sources -> (query_id, claim, verdict); a draft for which it gives no row, not
        even one without a claim, is one that could not be audited, and is withheld.
        """
        outcomes = scratch.written(self.route(queries), "outcomes")
        found = scratch.written(answers.sources(outcomes, self.pairs(), self.chunks()), "sources")
        counts = found.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_sources"))
        drafts = answers.remap_citations(outcomes.join(generate(found), "query_id", "left").join(counts, "query_id", "left"), "text", "n_sources")
        drafts = scratch.written(drafts, "drafts")
        asked = drafts.where(tx.text_or_empty(F.col("text")) != "").where(~answers.may_skip_audit(self.cfg)).where(~answers.is_insufficient(F.col("text")))
        verdicts = scratch.written(audit(asked.select("query_id", answers.strip_sentinel(F.col("text")).alias("text")), found), "verdicts")
        state = asked.select("query_id", F.lit(True).alias("asked")).join(verdicts.select("query_id").distinct().withColumn("audited", F.lit(True)), "query_id", "left")
        state = state.select("query_id", F.col("audited").isNull().alias("audit_failed"))
        judged = drafts.join(answers.groundedness(verdicts), "query_id", "left").join(state, "query_id", "left").withColumn("audit_failed", F.coalesce("audit_failed", F.lit(False)))
        done = answers.finish(judged, self.cfg)
        done = done.join(answers.citations(done, found), "query_id", "left").join(answers.near_misses(outcomes, self.pairs(), self.chunks()), "query_id", "left")
        nothing = F.array().cast("array<string>")
        done = done.withColumn("citations", F.when(F.col("answered"), F.col("citations"))).withColumn("near_misses", F.coalesce("near_misses", nothing))
        return done.withColumn("notes", answers.notes(self.cfg))

    def question_bank(self, **filters) -> DataFrame:
        return self.pairs().where(bank.matches(**filters))

    def question_bank_page(self, offset: int = 0, limit: int | None = None, **filters) -> DataFrame:
        return bank.page(self.question_bank(**filters), offset, limit or self.cfg.page_size)

    def question_bank_summary(self) -> DataFrame:
        return bank.summary(self.pairs())

    def documents(self) -> DataFrame:
        return bank.listing(self.chunks(), self.pairs()).orderBy(tx.casefold(F.col("doc_name")), "doc_id")

    def stats(self) -> dict[str, int]:
        """Documents, chunks and questions."""
        row = self.documents().agg(F.count(F.lit(1)), F.coalesce(F.sum("chunk_count"), F.lit(0)), F.coalesce(F.sum("qa_count"), F.lit(0))).first()
        return dict(zip(("n_documents", "n_chunks", "n_questions"), map(int, row)))

    def upsert_qa_pair(self, rows: DataFrame) -> None:
        """Add or edit entries by hand."""
        columns = [c.split()[0] for c in schemas.QA_PAIRS.split(", ")]
        self.store.upsert("qa_pairs", bank.manual_pair(rows).select(*columns), "qa_id")

    def delete_document(self, doc_id: str) -> None:
        self.store.delete_all(["chunks", "qa_pairs", "chunk_postings", "chunk_vectors"], "doc_id", doc_id)

    def delete_qa_pair(self, qa_id: str) -> None:
        self.store.delete("qa_pairs", "qa_id", qa_id)

    def reset(self) -> None:
        self.store.reset()

    def export(self, path: str, **filters) -> None:
        """The filtered bank as JSON lines."""
        files.export_json(self.question_bank(**filters), path)

    def reviews(self) -> DataFrame:
        return self.store.read("reviews", schemas.REVIEWS)

    def flag(self, answered: DataFrame) -> None:
        """Park answers (of ask(), with their queries) for review; flagging a query again updates its entry but keeps edited drafts."""
        fresh = records.flagged(answered, self.pairs())
        self.store.publish("reviews", records.merge_reviews(self.reviews(), fresh))

    def update_review(self, edits: DataFrame) -> None:
        """Save drafts: (review_id, and any of the columns of reviews)."""
        self.store.publish("reviews", records.edited(self.reviews(), edits))

    def discard_review(self, review_id: str) -> None:
        self.store.delete("reviews", "review_id", review_id)

    def approve_reviews(self) -> None:
        """File all pending reviews in the bank, with the provenance of documents that are gone cleared, and drop them from the queue."""
        filed = records.with_provenance(self.reviews(), self.chunks())
        self.upsert_qa_pair(filed.withColumn("qa_id", F.col("source_qa_id")))
        self.store.publish("reviews", self.spark.createDataFrame([], schemas.REVIEWS))

    def record(self, events: DataFrame, path: str) -> None:
        """Append metrics events to JSON lines."""
        records.append(events, path)

    def evaluate(self, golden: DataFrame, route_only: bool = False) -> DataFrame:
        """Rates of a golden set (query_id, query, …)."""
        if route_only:
            out = self.route(golden).withColumn("answered", F.col("route") != "refused").withColumn("groundedness", F.lit(None).cast("double")).withColumn("answer", F.lit(""))
        else:
            out = self.ask(golden)
        return records.evaluate(golden, out)

    def baseline(self, queries: DataFrame) -> DataFrame:
        """What plain passage search would do: phrasings fused, and the base threshold only."""
        best = self.search_phrasings(queries).groupBy("query_id").agg(F.max("score").alias("confidence"))
        out = queries.select("query_id").join(best, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        hit = F.col("confidence") >= self.cfg.vector_threshold
        return out.select("query_id", F.when(hit, "vector_rag").otherwise("refused").alias("route"), hit.alias("answered"), "confidence", F.lit(None).cast("double").alias("groundedness"), F.lit("").alias("answer"))

    def compare(self, golden: DataFrame) -> DataFrame:
        """Rates of routing and of plain passage search side by side."""
        return records.compare(self.evaluate(golden, route_only=True), records.evaluate(golden, self.baseline(golden)))

    def _chunk_index(self) -> sparse.SparseIndex:
        """The index of the postings that ingest has written."""
        stored = self.store.read("chunk_postings", "key string, dl int, term string, tf long, head boolean, doc_id string")
        return sparse.index_of(stored.drop("doc_id"), self.cfg)

    def _numbers(self, queries: DataFrame) -> DataFrame:
        return queries.select(F.col("query_id").alias("id"), F.xxhash64("query_id").alias("qn"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        return models.embed(queries.select(F.xxhash64("query_id").alias("qn"), F.col("query")), "query", "vector", self.embedder, optional=True)
