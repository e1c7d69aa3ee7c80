"""The subpackage's queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from lodestone.llm import jaccardjoin

    return jaccardjoin.join_query(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every document."""
    import public_tokenizers

    from lodestone.llm import bpe

    return bpe.digest_query(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from lodestone.llm import htmltext

    return htmltext.extraction_query(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    from lodestone.llm import quality

    return quality.quality_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    from lodestone.llm import urlfilter

    return urlfilter.url_query(_table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    from lodestone.llm import langid

    return langid.language_query(_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    from lodestone.llm import collision

    return collision.nearest_query(_table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents."""
    from lodestone.llm import mixing

    return mixing.mixing_query(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings leave of every document."""
    from lodestone.llm import suffixdedup

    return suffixdedup.dedup_query(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    from lodestone.llm import toxicity

    return toxicity.toxicity_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_bpe": op2_bpe,
        "op3_html": op3_html,
        "op4_quality": op4_quality,
        "op5_urls": op5_urls,
        "op6_language": op6_language,
        "op7_nearest": op7_nearest,
        "op8_mixing": op8_mixing,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express on whole tables."""
    from lodestone.llm import mixing, quality, urlfilter

    return {"op4_quality": quality.quality_sql(), "op5_urls": urlfilter.url_sql(), "op8_mixing": mixing.mixing_sql()}
