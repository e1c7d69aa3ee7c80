"""Evidence grounding and validation of extracted question/answer pairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import DIFFICULTIES, QUESTION_TYPES, EngineConfig
from lodestone.functions import text as tx
from lodestone.sources import scratch

TOKEN = re.compile(r"\w+")
#: Bytes of text that are cut into words at a time.
PIECE = 1 << 20


def holds(text: Column, quote: Column) -> Column:
    """Whether a text holds a quote's words in sequence."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(tx.grounding_tokens(c), " "), F.lit(" "))
    return F.contains(padded(text), padded(quote))


def find_span(text: str, quote: str, cfg: EngineConfig = EngineConfig()) -> str | None:
    """The passage of a text that a quote refers to: its words in sequence, else the window of best Jaccard.

    Windows are as long as the quote, a fifth shorter and a fifth longer; their overlaps are kept up to
    date as they slide, so a scan is linear in the text.
    """
    want = [m.group().casefold() for m in TOKEN.finditer(quote or "")]
    spans = [m.span() for m in TOKEN.finditer(text or "")]
    if len(want) < cfg.min_evidence_tokens or not spans:
        return None
    have = [text[a:b].casefold() for a, b in spans]
    joined = f" {' '.join(have)} "
    at = joined.find(f" {' '.join(want)} ")
    if at >= 0:
        first = joined[: at + 1].count(" ") - 1
        return text[spans[first][0] : spans[first + len(want) - 1][1]]
    wanted, best = set(want), (0.0, 0, 0)
    n = len(want)
    for size in sorted({n, max(cfg.min_evidence_tokens, int(n * 0.8)), int(n * 1.2) + 1}):
        if size > len(have):
            continue
        inside: dict[str, int] = {}
        hits = 0
        for k, word in enumerate(have):
            inside[word] = inside.get(word, 0) + 1
            hits += inside[word] == 1 and word in wanted
            if k >= size:
                old = have[k - size]
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
                    hits -= old in wanted
            if k >= size - 1 and hits:
                score = hits / (len(wanted) + len(inside) - hits)
                if score > best[0]:
                    best = (score, k - size + 1, k)
    return text[spans[best[1]][0] : spans[best[2]][1]] if best[0] >= cfg.evidence_jaccard else None


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of PIECE bytes of text or little more, a row at least, so that few words are held as Python's objects at a time."""
    ends = np.cumsum(sum(np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64) for c in batch.columns))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, PIECE + (ends[start - 1] if start else 0), "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _by_pieces(of: Callable, kind: pa.DataType) -> Callable:
    """of, on rows of strings, as a function of Arrow columns that takes them in pieces."""

    def run(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(columns), [str(k) for k in range(len(columns))])
        parts = [pa.array([of(*row) for row in zip(*(c.to_pylist() for c in piece.columns))], kind) for piece in _pieces(batch)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def locate(pairs: DataFrame, text: str, quote: str, out: str = "span", cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """pairs with the passage that each quote refers to, or null."""
    find = _by_pieces(lambda t, q: find_span(t, q, cfg), pa.string())

    @F.arrow_udf("string")
    def span(texts: pa.Array, quotes: pa.Array) -> pa.Array:
        return find(texts, quotes)

    return pairs.withColumn(out, span(text, quote))


def _words(text: str | None) -> list[str]:
    """Different words of a text, as find_span reads them, in order of appearance."""
    return list(dict.fromkeys(m.group().casefold() for m in TOKEN.finditer(text or "")))


def candidates(docs: DataFrame, quotes: DataFrame, text: str, quote: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Every pair of a row of docs and a row of quotes that locate() may find, with the columns of both (whose names differ).

    A window of Jaccard j holds j of the quote's different words at least. So a text may lack 1 - j of them, and
    of one more than that, the rarest ones, it holds at least one: an equi-join on those loses no pair.
    Texts are cut into words once, and only the quotes' words of each are kept.
    """
    cut, count = _by_pieces(_words, pa.list_(pa.string())), _by_pieces(lambda t: len(TOKEN.findall(t or "")), pa.int64())

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return cut(texts)

    @F.arrow_udf("long")
    def length(texts: pa.Array) -> pa.Array:
        return count(texts)

    row = docs.withColumn("__doc", F.xxhash64(*docs.columns))
    ask = quotes.withColumn("__ask", F.xxhash64(*quotes.columns)).where(length(quote) >= cfg.min_evidence_tokens).withColumn("__want", words(quote))
    ask = scratch.written(ask.withColumn("__need", F.ceil(F.size("__want") * F.lit(cfg.evidence_jaccard) - 1e-9)), "quotes")
    wanted = ask.select("__ask", "__need", F.size("__want").alias("__n"), F.explode("__want").alias("word")).distinct()
    posts = row.select("__doc", F.explode(words(text)).alias("word")).join(scratch.small(wanted.select("word").distinct()), "word", "left_semi")
    posts = scratch.written(posts, "quoted-words")
    seen = wanted.join(posts.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word", "left")
    rarest = Window.partitionBy("__ask").orderBy(F.coalesce("df", F.lit(0)), "word")
    first = seen.withColumn("__at", F.row_number().over(rarest)).where(F.col("__at") <= F.col("__n") - F.col("__need") + 1).select("__ask", "word")
    met = posts.join(first, "word").select("__ask", "__doc").distinct()
    held = met.join(wanted, "__ask").join(posts.distinct(), ["__doc", "word"]).groupBy("__ask", "__doc").agg(F.count(F.lit(1)).alias("__both"), F.first("__need").alias("__need"))
    pairs = scratch.written(held.where(F.col("__both") >= F.col("__need")).select("__ask", "__doc"), "quoted-pairs")
    return row.join(scratch.small(pairs), "__doc").join(ask, "__ask").select(*docs.columns, *quotes.columns)


def distinct_texts(values: Column, most: int) -> Column:
    """White space folded, without blanks and without texts that match an earlier one; the first `most`."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: tx.one_space(tx.text_or_empty(v))), lambda v: tx.match_key(v) != "")
    first = F.filter(F.transform(clean, lambda v: F.struct(v.alias("v"), tx.match_key(v).alias("k"))), lambda x: F.lit(True))
    kept = F.aggregate(first, F.array().cast("array<struct<v:string,k:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.array_append(acc, x)))
    return F.slice(F.transform(kept, lambda x: x["v"]), 1, most)


def validate(raw: DataFrame, chunks: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Question/answer pairs that survive: raw is (chunk_id, pos, question, answer, question_type, difficulty, evidence, paraphrases, keywords).

    A pair needs a question, an answer of min_answer characters, and evidence found in its chunk.
    """
    c = raw.withColumn("question", tx.clean_question(F.col("question"))).withColumn("answer", tx.clean_answer(F.col("answer"))).withColumn("qkey", tx.match_key(F.col("question")))
    c = c.where((F.length("question") >= 2) & (F.length("answer") >= cfg.min_answer) & (F.col("qkey") != "")).join(chunks.select("chunk_id", "text", "doc_id", "doc_name", "section", "page_start", "page_end"), "chunk_id")
    quotes = locate(c.select("chunk_id", "pos", "text", F.posexplode("evidence").alias("nth", "quote")).where(tx.strip(F.col("quote")) != ""), "text", "quote", cfg=cfg).where("span is not null")
    quotes = quotes.withColumn("key", tx.match_key(F.col("span"))).withColumn("first", F.row_number().over(Window.partitionBy("chunk_id", "pos", "key").orderBy("nth"))).where("first = 1 and key <> ''")
    grounded = quotes.groupBy("chunk_id", "pos").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("nth", "span"))), lambda x: tx.strip(x["span"])), 1, cfg.max_evidence).alias("evidence"))
    other = F.filter(distinct_texts(F.col("paraphrases"), 6), lambda p: tx.match_key(p) != F.col("qkey"))
    out = c.drop("evidence").join(grounded, ["chunk_id", "pos"]).withColumn("paraphrases", F.slice(other, 1, 3)).withColumn("keywords", distinct_texts(F.col("keywords"), 8))
    out = out.withColumn("question_type", tx.coerce_vocabulary(F.col("question_type"), QUESTION_TYPES, "factual")).withColumn("difficulty", tx.coerce_vocabulary(F.col("difficulty"), DIFFICULTIES, "intermediate"))
    return out.withColumn("qa_id", tx.stable_id(F.col("chunk_id"), F.col("qkey"))).drop("text")


def merge_longest(rows: DataFrame, question: str, answer: str, order: list[str]) -> DataFrame:
    """One row for each matching question: the longest answer, the earliest if tied."""
    w = Window.partitionBy("__key").orderBy(F.length(answer).desc(), *order)
    return rows.withColumn("__key", tx.match_key(F.col(question))).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__key", "__n")
