"""Metrics events, review queue and golden-set evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as tx


def metrics_summary(events: DataFrame, ts: str = "ts", key: str | None = None, last: int = 500) -> DataFrame:
    """One row over the last events: searches, answered, refused, refusal rate, and mean time of those that took any."""
    recent = events.orderBy(F.desc(ts), *([F.desc(key)] if key else [])).limit(last).where("kind = 'search'")
    n = F.count(F.lit(1))
    return recent.agg(
        n.alias("searches"),
        F.count_if("answered").alias("answered"),
        F.count_if(~F.col("answered")).alias("refused"),
        F.round(F.coalesce(F.try_divide(F.count_if(~F.col("answered")), n), F.lit(0.0)), 4).alias("refuse_rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("elapsed") != 0, F.col("elapsed"))), F.lit(0.0)), 2).alias("avg_latency"),
    )


def totals(events: DataFrame) -> DataFrame:
    """Lifetime totals by kind."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("answered").alias("answered"))


def review_id(query: Column) -> Column:
    return F.concat(F.lit("review_"), F.substring(F.sha2(tx.casefold(tx.strip(tx.text_or_empty(query))), 256), 1, 16))


#: Columns of a review that an editor drafts.
DRAFTS = ("question", "answer", "question_type", "difficulty", "keywords", "paraphrases", "evidence")


def _given(c: Column, kind: str) -> Column:
    """Whether a value is there and not empty."""
    return F.coalesce(F.size(c) > 0 if kind.startswith("array") else c != "", F.lit(False)) if kind.startswith(("array", "string")) else c.isNotNull()


def merge_reviews(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Reviews after flagging: a flagged query that is there takes what is new, but keeps its creation time and, once edited, its drafts.

    A review is edited once it was updated after its creation (without an update column: always).
    """
    kinds = dict(existing.dtypes)
    old = existing.select("review_id", *(F.col(c).alias(f"old_{c}") for c in existing.columns if c != "review_id"))
    both = fresh.withColumn("new", F.lit(True)).join(old, "review_id", "full")
    edited = F.coalesce(F.col("old_updated_at") != F.col("old_created_at"), F.lit(False)) if "updated_at" in kinds else F.lit(True)
    out = [F.col("review_id")]
    for c in existing.columns:
        if c == "review_id":
            continue
        was, now = F.col(f"old_{c}"), F.col(c)
        keep = F.col("new").isNull()
        if c == "created_at":
            keep = was.isNotNull()
        elif c in DRAFTS:
            keep = keep | edited & _given(was, kinds[c])
            if c in ("question_type", "difficulty", "keywords", "paraphrases"):
                keep = keep | _given(was, kinds[c]) & ~_given(now, kinds[c])
        elif c == "source_qa_id":
            keep = keep | _given(was, kinds[c]) & ~_given(now, kinds[c])
        out.append(F.when(keep, was).otherwise(now).alias(c))
    return both.select(*out)


def flagged(answered: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reviews of answers (query, answer, route, citations, qa_keys); the first matched pair gives what is known of the origin. Blank queries are left out."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    quotes = F.filter(F.transform(F.col("citations"), lambda c: tx.strip(tx.text_or_empty(c["quote"]))), lambda q: q != "")
    rows = answered.where(tx.strip(tx.text_or_empty(F.col("query"))) != "").select(
        review_id(F.col("query")).alias("review_id"), tx.strip(F.col("query")).alias("query"), tx.strip(F.col("query")).alias("question"), tx.strip(tx.text_or_empty(F.col("answer"))).alias("answer"), "route",
        F.coalesce(quotes, F.array().cast("array<string>")).alias("evidence"), now.alias("created_at"), now.alias("updated_at"), F.get("qa_keys", F.lit(0)).alias("source_qa_id"),
    )
    first = F.row_number().over(Window.partitionBy("review_id").orderBy("query", "answer"))
    rows = rows.withColumn("__n", first).where("__n = 1").drop("__n")
    origin = pairs.select(F.col("qa_id").alias("source_qa_id"), "chunk_id", "doc_id", "doc_name", "section", "question_type", "difficulty", "page_start", "page_end", "paraphrases", "keywords")
    both = rows.join(origin, "source_qa_id", "left")
    given = {"chunk_id": "", "doc_id": "manual", "doc_name": "Manual entries", "section": "", "question_type": "factual", "difficulty": "basic", "page_start": 0, "page_end": 0, "source_qa_id": ""}
    both = both.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in given.items()})
    return both.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("paraphrases", "keywords")})


def edited(reviews: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviews with the columns that edits (review_id, …) give, where they aren't null, and a new update time."""
    changed = [c for c in edits.columns if c in reviews.columns and c not in ("review_id", "created_at", "updated_at")]
    new = edits.select("review_id", F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in changed))
    both = reviews.join(new, "review_id", "left")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    value = lambda c: F.coalesce(f"__{c}", c) if c in changed else F.when(F.col("__new"), now).otherwise(F.col(c)) if c == "updated_at" else F.col(c)
    return both.select(*(value(c).alias(c) for c in reviews.columns))


def append(events: DataFrame, path: str) -> None:
    """Append events to JSON lines; what others append at the same time stays."""
    events.write.mode("append").json(path)


def search_events(answered: DataFrame, elapsed: Column) -> DataFrame:
    """Metrics events of answers."""
    return answered.select(F.unix_micros(F.current_timestamp()).cast("double").alias("us"), F.lit("search").alias("kind"), "route", "answered", "confidence", "groundedness", elapsed.cast("double").alias("elapsed")).withColumn("ts", F.col("us") / 1e6).drop("us")


def with_provenance(reviews: DataFrame, known_docs: DataFrame) -> DataFrame:
    """Reviews of documents that are gone, filed by hand with their provenance cleared."""
    known = known_docs.select("doc_id").distinct().withColumn("there", F.lit(True))
    r = reviews.join(known, "doc_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    keep = lambda c, other: F.when(F.col("there"), F.col(c)).otherwise(F.lit(other)).alias(c)
    changed = {"doc_id": "manual", "doc_name": "Manual entries", "chunk_id": "", "section": "", "page_start": 0, "page_end": 0}
    return r.select(*(keep(c, changed[c]) if c in changed else F.col(c) for c in reviews.columns))


def route_ok(actual: Column, expected: Column) -> Column:
    """Whether a route is one of those expected (null: any)."""
    return expected.isNull() | F.coalesce(F.array_contains(expected, actual), F.lit(False))


def contains_all(answer: Column, must: Column) -> Column:
    return F.forall(must, lambda p: F.contains(tx.casefold(tx.text_or_empty(answer)), tx.casefold(tx.text_or_empty(p))))


def evaluate(golden: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of rates: golden (query_id, expect_route, expect_answered, must_contain) against outcomes (query_id, route, answered, confidence, groundedness, answer)."""
    r = golden.join(outcomes, "query_id", "left").withColumn("route", F.coalesce("route", F.lit("refused"))).withColumn("answered", F.coalesce("answered", F.lit(False)))
    checked = F.coalesce(F.size("must_contain") > 0, F.lit(False)) & F.col("answered")
    n = F.count(F.lit(1))
    rate = lambda c: F.round(F.try_divide(F.count_if(c), F.greatest(n, F.lit(1))), 3)
    return r.agg(
        n.alias("total"),
        rate(route_ok(F.col("route"), F.col("expect_route"))).alias("route_accuracy"),
        rate(F.col("expect_answered").isNull() | (F.col("expect_answered") == F.col("answered"))).alias("answered_accuracy"),
        rate(~F.col("answered")).alias("refuse_rate"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 3).alias("avg_confidence"),
        F.round(F.avg("groundedness"), 3).alias("avg_groundedness"),
        F.round(F.try_divide(F.count_if(checked & contains_all(F.col("answer"), F.col("must_contain"))), F.count_if(checked)), 3).alias("contain_accuracy"),
    )


def compare(ours: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rates of two evaluations side by side, and their differences."""
    names = ("route_accuracy", "refuse_rate", "avg_confidence")
    cells = lambda t: t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names))).alias("m")).select("m.*")
    return cells(ours).join(cells(baseline).withColumnRenamed("value", "baseline"), "metric").withColumn("delta", F.round(F.col("value") - F.col("baseline"), 3))


def history(searches: DataFrame, most: int = 8) -> DataFrame:
    """The latest distinct queries, newest first."""
    w = Window.partitionBy("query").orderBy(F.desc("ts"))
    return searches.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").orderBy(F.desc("ts"), "query").limit(most)


def coverage(chunks: DataFrame, raw: DataFrame, pairs: DataFrame, samples: int = 8) -> DataFrame:
    """One row on an extraction: chunks asked, failed, without a pair, pairs kept, pairs for each chunk, and the first failures.

    raw: (chunk_id, question, error) as the extractor gave it; pairs: what was kept.
    """
    per = raw.groupBy("chunk_id").agg(F.first("error", ignorenulls=True).alias("error"), F.count("question").alias("n"))
    asked = chunks.select("chunk_id").distinct().join(per, "chunk_id", "left")
    kept = pairs.agg(F.count(F.lit(1)).alias("pairs_kept"))
    failures = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("chunk_id", "error")))), 1, samples), lambda x: F.concat_ws(": ", x["chunk_id"], x["error"]))
    row = asked.agg(F.count(F.lit(1)).alias("chunks"), F.count("error").alias("chunks_failed"), F.count_if(F.col("error").isNull() & (F.coalesce("n", F.lit(0)) == 0)).alias("chunks_empty"), failures.alias("failure_samples"))
    both = row.withColumn("__one", F.lit(1)).join(kept.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return both.withColumn("questions_per_chunk", F.round(F.coalesce(F.try_divide("pairs_kept", "chunks"), F.lit(0.0)), 2))


def batch_totals(reports: DataFrame) -> DataFrame:
    """One row of sums over the reports of a batch's documents (doc_id, pages, ocr_pages array<int>, chunks, questions, elapsed, error)."""
    return reports.agg(
        F.count_if(F.col("error").isNull()).alias("documents"),
        F.count("error").alias("failed"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "chunks", "questions", "elapsed")),
        F.coalesce(F.sum(F.size(F.coalesce("ocr_pages", F.array().cast("array<int>")))), F.lit(0)).alias("ocr_pages"),
    )
