"""The corpus pipeline: language identification, near duplicates, repeated strings, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents; other columns
of the docs are left out. Empty docs give empty results at every stage. No stage reads less than whole
texts, however long; what it does with nulls, empty texts, ties and repeated rows its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import bpe, jaccardjoin, langid, mixing, suffixdedup
from lodestone.llm.store import drop, join_small, lasting, passing, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language can be told: those without text or without a letter, also where no labels teach a network.

    Null and empty texts go; null ids, languages and sources stay as they are; repeated rows all stay.
    """
    rows = docs.select(*COLUMNS)
    net = langid.fit(rows, ~F.coalesce(langid.held_out(), F.lit(False)))
    if net is None:
        return rows.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(rows, net, pred="__lang", score="__score")
    return found.where(F.col("__lang") != langid.UNDETERMINED).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays (null first), once if its row repeats; documents without words stay.

    What is judged is an id with a text, known by the hash of both: other texts of the id, or without an id, belong to their own groups.
    """
    rows = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text"))
    groups = jaccardjoin.join(rows, doc_id="__key").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group")).distinct()
    known = rows.groupBy("__key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("__rows"))
    best = groups.join(known, "__key").groupBy("__group").agg(F.min(F.struct("id", "__key", "__rows")).alias("best"))
    stay = written(best.select("best.__key", "best.__rows"), "groups")
    kept = join_small(rows, stay, ["__key"], "inner", jaccardjoin.ASKED_ROWS)
    once = kept.where("__rows = 1").select(*COLUMNS)
    if not stay.where("__rows > 1").limit(1).count():
        return once
    copy = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars"))
    return once.unionByName(kept.where("__rows > 1").withColumn("__copy", copy).where("__copy = 1").select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier in the corpus are cut out; documents of which nothing is left go.

    Documents that lose nothing stay as they are, also empty texts, and a null text becomes an empty one; a null
    id stands before all others; repeated rows of one id lose the same; n_chars is counted anew where something went.
    """
    left = suffixdedup.dedup(docs.select(*COLUMNS))
    left = left.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a document stands there once for each copy that the mix takes, and goes if it takes none.

    Documents without words go; null sources are a source; repeated rows are taken one by one; a document at
    the end of a source's last pass is counted in part but stands whole.
    """
    return mixing.in_training_order(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, in the order of the mix; null and empty texts have no tokens, repeated rows equal ones."""
    import public_tokenizers

    return bpe.encode_digests(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing():  # what a stage writes on its way goes once its result is written
            after = lasting(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
