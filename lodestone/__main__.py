"""Command line: ingest documents, ask, list, browse, evaluate. Results are JSON lines on the standard output."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.plans.engine import Engine
from lodestone.sources import files


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m lodestone", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the tables")
    do = p.add_subparsers(dest="do", required=True)
    one = do.add_parser("ingest", help="index documents (Parquet: doc_id, text; or web pages: page_id, url, html)")
    one.add_argument("path")
    one.add_argument("--force", action="store_true", help="also documents that are indexed")
    do.add_parser("ask", help="answer questions").add_argument("question", nargs="+")
    do.add_parser("documents", help="list documents")
    do.add_parser("stats", help="count documents, chunks and questions")
    one = do.add_parser("bank", help="browse the question bank")
    one.add_argument("--doc", default=None)
    one.add_argument("--search", default=None)
    one.add_argument("--offset", type=int, default=0)
    one = do.add_parser("evaluate", help="rates of a golden set (JSON)")
    one.add_argument("path")
    one.add_argument("--route-only", action="store_true")
    one.add_argument("--baseline", action="store_true", help="beside plain passage search")
    do.add_parser("delete", help="drop a document").add_argument("doc_id")
    do.add_parser("reset", help="drop everything")
    return p.parse_args(argv)


def run(e: Engine, a: argparse.Namespace) -> DataFrame | dict | None:
    """What a command gives."""
    if a.do == "ingest":
        rows = e.spark.read.parquet(a.path)
        return e.ingest(files.html_pages(rows) if "html" in rows.columns else files.documents_as_pages(rows), a.force)
    if a.do == "ask":
        asked = e.spark.createDataFrame([(str(k), q) for k, q in enumerate(a.question, 1)], "query_id string, query string")
        return asked.join(e.ask(asked), "query_id").select("query", "route", "answered", "answer", "confidence", "citations", "near_misses", "notes").orderBy("query")
    if a.do == "documents":
        return e.documents()
    if a.do == "stats":
        return e.stats()
    if a.do == "bank":
        return e.question_bank_page(a.offset, doc_id=a.doc, needle=a.search)
    if a.do == "evaluate":
        golden = files.golden_questions(e.spark, a.path)
        return e.compare(golden) if a.baseline else e.evaluate(golden, a.route_only)
    if a.do == "delete":
        e.delete_document(a.doc_id)
    if a.do == "reset":
        e.reset()
    return None


def main(argv: list[str]) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = run(Engine(spark, a.store, EngineConfig.from_env()), a)
    if isinstance(out, dict):
        out = spark.createDataFrame([tuple(out.values())], list(out))
    for row in out.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator() if out is not None else ():
        print(row.j)


if __name__ == "__main__":
    main(sys.argv[1:])
