"""The question bank: search rows, listings, filters and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DIFFICULTIES, HARD_TYPES, QUESTION_TYPES, EngineConfig
from lodestone.functions import text as tx


def search_rows(pairs: DataFrame) -> DataFrame:
    """(row_id, qa_id, row_kind, text): the question and each paraphrase that isn't blank."""
    asked = pairs.select("qa_id", F.concat(F.col("qa_id"), F.lit("::q")).alias("row_id"), F.lit("question").alias("row_kind"), F.col("question").alias("text"))
    more = pairs.select("qa_id", F.posexplode("paraphrases").alias("k", "text")).where(tx.strip(F.col("text")) != "")
    return asked.unionByName(more.select("qa_id", F.concat("qa_id", F.lit("::p"), F.col("k")).alias("row_id"), F.lit("paraphrase").alias("row_kind"), "text"))


def sparse_text(pairs: DataFrame) -> DataFrame:
    """(qa_id, text): question, paraphrases and keywords as one document."""
    parts = F.concat(F.array("question"), F.coalesce("paraphrases", F.array().cast("array<string>")), F.coalesce("keywords", F.array().cast("array<string>")))
    return pairs.select("qa_id", F.array_join(parts, " ").alias("text"))


def matches(doc_id: str | None = None, types: list[str] | None = None, levels: list[str] | None = None, needle: str | None = None) -> Column:
    """Filter of the bank: document, types, levels, and a text in question, answer or a keyword."""
    out = F.lit(True)
    if doc_id:
        out = out & (F.col("doc_id") == doc_id)
    if types:
        out = out & F.col("question_type").isin(types)
    if levels:
        out = out & F.col("difficulty").isin(levels)
    if needle and needle.strip():
        has = lambda c: F.contains(tx.casefold(tx.text_or_empty(c)), tx.casefold(F.lit(needle.strip())))
        out = out & (has(F.col("question")) | has(F.col("answer")) | F.coalesce(F.exists("keywords", has), F.lit(False)))
    return out


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the bank, sorted by document, page and question."""
    return rows.orderBy(tx.casefold(F.col("doc_name")), "page_start", tx.casefold(F.col("question")), "qa_id").offset(max(0, offset)).limit(max(1, limit))


def listing(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, doc_name, chunk_count, qa_count) of documents on either side; parents count as chunks."""
    a = chunks.select("doc_id", "doc_name", F.lit(1).alias("c"), F.lit(None).cast("string").alias("q"))
    b = pairs.select("doc_id", "doc_name", F.lit(0).alias("c"), F.col("qa_id").cast("string").alias("q"))
    return a.unionByName(b).groupBy("doc_id").agg(F.min("doc_name").alias("doc_name"), F.sum("c").alias("chunk_count"), F.count_distinct("q").alias("qa_count"))


def summary(pairs: DataFrame) -> DataFrame:
    """(grouping, name, n): totals, types and levels of distinct questions, in one pass of grouping sets."""
    one = pairs.dropDuplicates(["qa_id"]).select("question_type", "difficulty", F.col("question_type").isin(*HARD_TYPES).cast("int").alias("hard"))
    sets = one.groupingSets([["question_type"], ["difficulty"], []], "question_type", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.sum("hard").alias("hard"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "difficulty").otherwise("total")
    return sets.select(kind.alias("grouping"), F.coalesce("question_type", "difficulty", F.lit("")).alias("name"), "n", F.coalesce("hard", F.lit(0)).alias("hard"))


def zero_filled(rows: DataFrame, column: str, vocabulary: tuple[str, ...]) -> DataFrame:
    """(name, n, share) for every word of a vocabulary, also those that no row has."""
    names = rows.sparkSession.createDataFrame([(v,) for v in vocabulary], "name string")
    counts = rows.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = F.greatest(F.lit(1), F.sum("n").over(_all()))
    return names.join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("share", F.round(F.col("n") / total, 3))


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0))


def extraction_report(pairs: DataFrame) -> dict[str, DataFrame]:
    """Distributions and totals of extracted pairs."""
    totals = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("chunk_id").alias("chunks_covered"), F.round(F.avg(F.size("evidence")), 2).alias("evidence_per_pair"), F.round(F.avg(F.length("answer")), 1).alias("answer_chars"))
    return {"totals": totals, "types": zero_filled(pairs, "question_type", QUESTION_TYPES), "difficulties": zero_filled(pairs, "difficulty", DIFFICULTIES), "documents": pairs.groupBy("doc_name").agg(F.count(F.lit(1)).alias("n"))}


#: What an entry filed by hand has where nothing is given.
MANUAL = {"question_type": "'factual'", "difficulty": "'basic'", "evidence": "cast(array() as array<string>)", "paraphrases": "cast(array() as array<string>)", "keywords": "cast(array() as array<string>)", "doc_id": "''", "doc_name": "''", "section": "''", "page_start": "0", "page_end": "0", "qa_id": "''", "chunk_id": "''"}


def manual_pair(rows: DataFrame) -> DataFrame:
    """Rows (question, answer, …) as bank entries filed by hand; columns that are absent or null get defaults, blank questions or answers are dropped.

    A row that names an entry keeps its id and its origin; a new one gets an id of its document and question.
    """
    out = rows.withColumns({c: F.coalesce(F.col(c), F.expr(v)) if c in rows.columns else F.expr(v) for c, v in MANUAL.items()})
    out = out.withColumn("question", tx.strip(tx.text_or_empty(F.col("question")))).withColumn("answer", tx.strip(tx.text_or_empty(F.col("answer")))).where("question <> '' and answer <> ''")
    out = out.withColumn("doc_id", F.when(tx.strip(F.col("doc_id")) == "", F.lit("manual")).otherwise(F.col("doc_id")))
    out = out.withColumn("doc_name", F.when(F.col("doc_id") == "manual", F.lit("Manual entries")).otherwise(F.col("doc_name")))
    new = tx.stable_id(F.lit("manual"), F.col("doc_id"), F.col("question"))
    return out.withColumn("qa_id", F.when(F.col("qa_id") == "", new).otherwise(F.col("qa_id")))
