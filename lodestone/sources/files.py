"""Readers and writers: documents, PDF files, web pages, golden questions, exports, cached extractions."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as tx
from lodestone.sources import scratch


def documents_as_pages(docs: DataFrame) -> DataFrame:
    """Documents as single pages (doc_id, doc_name, page_number, text)."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("doc_name"), F.lit(1).alias("page_number"), tx.text_or_empty(F.col("text")).alias("text"))


def pdf_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, errors): PDF files with their doc_id, and files that aren't PDF; one bad file stops nothing."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"), F.regexp_extract("path", r"([^/]+)$", 1).alias("doc_name"))
    good = F.position(F.lit("%PDF").cast("binary").cast("string"), F.substring(F.col("content"), 1, 1024).cast("string")) > 0
    files = raw.where(good).withColumn("doc_id", tx.stable_id(F.sha2("content", 256)))
    return files, raw.where(~good).select("path", F.lit("not a PDF file").alias("error"))


def pdf_pages(files: DataFrame, read_pages: Callable[[bytes], list[str]]) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of PDF files by a given reader (there is none in this repository); a file that fails, or has no page, is an error and stops nothing."""

    def run(parts):
        for p in parts:
            rows = []
            for doc, name, body in zip(p.doc_id, p.doc_name, p.content):
                try:
                    got = [(doc, name, k, t, None) for k, t in enumerate(read_pages(bytes(body)), 1)]
                    rows += got or [(doc, name, None, None, "no pages")]
                except Exception as e:  # whatever the reader raises; the file goes to the errors
                    rows.append((doc, name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_name", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    read = scratch.written(files.select("doc_id", "doc_name", "content").mapInPandas(run, f"{schemas.PAGES}, error string"), "pages")
    return read.where("error is null").drop("error"), read.where("error is not null").select("doc_id", "doc_name", "error")


def page_count(files: DataFrame, read_pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc_id, doc_name, pages) of files that can be read."""
    return pdf_pages(files, read_pages)[0].groupBy("doc_id", "doc_name").agg(F.count(F.lit(1)).alias("pages"))


def ocr_pages(images: DataFrame, recognise: Callable[[list[bytes]], list[list[tuple[str, float]]]], cache: DataFrame | None = None, window: int = 4) -> DataFrame:
    """(doc_id, page_number, lines) of page images (doc_id, page_number, image), by a given recogniser (there is none in this repository).

    Each page is read once, in windows of a few; pages in the cache (doc_id, page_number, lines) aren't read
    again; a window that fails is read page by page, and a page that fails has no lines.
    """
    key = ["doc_id", "page_number"]
    todo = images.where("page_number >= 1").dropDuplicates(key)
    if cache is not None:
        todo = todo.join(cache.select(*key), key, "left_anti")

    def one(batch: list[bytes]) -> list[list[tuple[str, float]]]:
        try:
            got = recognise(batch)
            if len(got) == len(batch):
                return got
        except Exception:  # whatever the recogniser raises
            pass
        return [[]] if len(batch) == 1 else [x for b in batch for x in one([b])]

    def run(parts):
        for p in parts:
            images_ = [bytes(x) for x in p.image]
            found = [x for k in range(0, len(images_), window) for x in one(images_[k : k + window])]
            yield pd.DataFrame({"doc_id": p.doc_id, "page_number": p.page_number, "lines": [[{"text": t, "conf": float(c)} for t, c in x] for x in found]})

    shape = "doc_id string, page_number int, lines array<struct<text:string,conf:double>>"
    fresh = todo.select("doc_id", F.col("page_number").cast("int").alias("page_number"), "image").mapInPandas(run, shape)
    return fresh if cache is None else fresh.unionByName(cache.select(*key, "lines").join(images.select(*key).distinct(), key, "left_semi"))


def html_pages(pages: DataFrame) -> DataFrame:
    """Visible text of web pages, a line for each block, as pages: markup, scripts and styles dropped, character references decoded (only texts that hold any leave the JVM)."""

    @F.pandas_udf("string")
    def unescaped(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    body = tx.text_or_empty(F.col("html"))
    bare = F.regexp_replace(body, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", " ")
    lines = F.regexp_replace(bare, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|td|th|article|section|header|footer|nav|aside|main|br)\b[^>]*>", "\n")
    rows = pages.select(F.col("page_id").cast("string").alias("doc_id"), tx.text_or_empty(F.col("url")).alias("doc_name"), F.lit(1).alias("page_number"), F.regexp_replace(lines, r"<[^>]*>", "").alias("text"))
    rows = rows.withColumn("text", F.coalesce(unescaped(F.when(F.contains("text", F.lit("&")), F.col("text"))), F.col("text")))
    kept = F.filter(F.transform(F.split("text", "\n"), tx.one_space), lambda x: x != "")
    return rows.withColumn("text", F.array_join(kept, "\n"))


def golden_questions(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions of a JSON array; a scalar route becomes a list of one."""
    raw = spark.read.option("multiLine", True).schema("id string, query string, expect_route string, expect_answered boolean, must_contain array<string>").json(path)
    listed = F.when(F.col("expect_route").startswith("["), F.from_json("expect_route", "array<string>")).when(F.col("expect_route").isNotNull(), F.array("expect_route"))
    return raw.select(F.col("id").alias("query_id"), "query", listed.alias("expect_route"), "expect_answered", "must_contain")


def export_json(bank: DataFrame, path: str) -> None:
    """The filtered bank as JSON lines."""
    bank.write.mode("overwrite").json(path)


def cache_key(doc_id, ordinal, text, neighbours: bool = True, fingerprint: str = ""):
    """Key of a cached extraction; the fingerprint stands for model, prompt and limits."""
    zero = F.lit("\0")
    return F.sha2(F.concat(doc_id, zero, ordinal.cast("string"), zero, text, zero, F.lit(f"neighbors={int(neighbours)}{fingerprint}")), 256)


def metrics_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """Metrics events of JSON lines; what can't be read is left out."""
    try:
        return spark.read.schema(schemas.METRICS).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # the folder may not be there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.METRICS)
