"""Answers: sources, citations, the refusal sentinel, audits and notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import REFUSAL, EngineConfig
from lodestone.functions import text as tx

SENTINEL = "INSUFFICIENT_CONTEXT"
#: What separates numbers in a citation marker, and marks that no space stands before.
SEPARATORS, TIGHT = ",;،؛", ".,;:!?)]"


def is_insufficient(answer: Column) -> Column:
    """Whether a reply is the sentinel, alone or with little around it, or blank."""
    t = tx.text_or_empty(answer)
    rest = F.regexp_replace(F.regexp_replace(t, f"(?i){SENTINEL}", ""), r"[^\p{L}\p{N}]+", "")
    return (tx.strip(t) == "") | (F.contains(F.upper(t), F.lit(SENTINEL)) & (F.length(rest) <= 60))


def strip_sentinel(answer: Column) -> Column:
    """A reply without the lines that hold the sentinel."""
    return tx.strip(F.regexp_replace(F.regexp_replace(tx.text_or_empty(answer), f"(?im)^.*{SENTINEL}.*$", ""), r"\n{3,}", "\n\n"))


def bracketed(inner: str) -> list[int] | None:
    """What stands between brackets: the numbers of a marker, none if it is numbers in another form, None if it is text."""
    listed = [x.strip() for x in re.split(f"[{SEPARATORS}]", inner)]
    if all(x.isdecimal() for x in listed):
        return [int(x) for x in listed]
    first, *between = re.split(r"\d+", inner)
    if not between or first.strip() or between[-1].strip() or any(len(gap.strip()) > 3 for gap in between[:-1]):
        return None
    return []


def scanned(answer: str) -> Iterator[str | list[int]]:
    """An answer as stretches of text and, in between, the numbers of its bracketed groups."""
    said = at = 0
    while (at := answer.find("[", at)) >= 0 and (end := answer.find("]", at)) >= 0:
        numbers = bracketed(answer[at + 1 : end])
        if numbers is None:
            at += 1
            continue
        yield answer[said:at]
        yield numbers
        said = at = end + 1
    yield answer[said:]


def renumber(answer: str, valid: int) -> tuple[str, list[int]]:
    """Markers renumbered from 1 in order of appearance, others dropped; and the sources cited."""
    known: dict[int, int] = {}
    out = ""
    for part in scanned(answer):
        if isinstance(part, str):
            out += part
        else:
            real = [n for n in part if 1 <= n <= valid]
            out += "".join(f"[{k}]" for k in dict.fromkeys(known.setdefault(n, len(known) + 1) for n in real))
    tidy = lambda m: "" if out[m.end() : m.end() + 1] in tuple(TIGHT) else " " if len(m[0]) > 1 else m[0]
    return re.sub(r"[ \t]+", tidy, out).strip(), list(known)


def remap_citations(rows: DataFrame, answer: str, n_sources: str) -> DataFrame:
    """rows with the answer renumbered and cited: the sources' numbers in new order."""

    @F.pandas_udf("text string, cited array<int>")
    def mapped(texts: pd.Series, valid: pd.Series) -> pd.DataFrame:
        got = [renumber(t or "", int(n)) for t, n in zip(texts, valid)]
        return pd.DataFrame({"text": [g[0] for g in got], "cited": [g[1] for g in got]})

    return rows.withColumn("__m", mapped(answer, F.coalesce(F.col(n_sources), F.lit(0)))).withColumn(answer, F.col("__m.text")).withColumn("cited", F.col("__m.cited")).drop("__m")


def uncited(answer: Column) -> Column:
    """Sentences of 40 characters or more without a marker, cut to 160."""
    parts = F.transform(F.split(tx.strip(tx.text_or_empty(answer)), r"(?<=[.!?۔؟])\s+"), tx.strip)
    return F.transform(F.filter(parts, lambda p: (F.length(p) >= 40) & ~p.rlike(r"\[\d+\]")), lambda p: F.substring(p, 1, 160))


def best_evidence(evidence: Column, answer: Column) -> Column:
    """The quote that shares most words with the answer, the longest if tied; without quotes the answer."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({tx.WORD})"), 1))
    quotes = F.filter(F.transform(F.coalesce(evidence, F.array().cast("array<string>")), lambda q: tx.strip(tx.text_or_empty(q))), lambda q: q != "")
    scored = F.transform(quotes, lambda q, i: F.struct(F.size(F.array_intersect(words(answer), words(q))).alias("n"), F.length(q).alias("l"), (-i).alias("i"), q.alias("q")))
    return F.when(F.size(quotes) > 0, F.array_max(scored)["q"]).otherwise(answer)


def sources(outcomes: DataFrame, pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, index, origin, doc_name, page_label, section, body, quote, audit_body): numbered sources of each query.

    Pairs come first, each once; what an audit may check is document text only: a pair's quotes and its
    chunk, or a hand-written answer with its quotes.
    """
    asked = outcomes.where("route <> 'refused'")
    label = tx.page_label(F.col("page_start"), F.col("page_end"))
    qa = asked.select("query_id", F.posexplode(F.array_distinct("qa_keys")).alias("pos", "qa_id")).join(pairs, "qa_id")
    qa = qa.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id", "left")
    quotes = F.array_join("evidence", "\n")
    audit = F.when(F.col("chunk_id") == "", F.concat_ws("\n", F.col("answer"), quotes)).otherwise(F.concat_ws("\n", quotes, F.col("chunk_text")))
    qa = qa.select("query_id", F.lit(0).alias("side"), "pos", F.lit("question_bank").alias("origin"), "doc_name", label.alias("page_label"), "section", F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer")).alias("body"), tx.excerpt(best_evidence(F.col("evidence"), F.col("answer"))).alias("quote"), audit.alias("audit_body"))
    ck = asked.select("query_id", F.posexplode(F.array_distinct("chunk_keys")).alias("pos", "chunk_id")).join(chunks, "chunk_id")
    ck = ck.select("query_id", F.lit(1).alias("side"), "pos", F.lit("vector_rag").alias("origin"), "doc_name", label.alias("page_label"), "section", F.col("text").alias("body"), tx.excerpt(F.col("text")).alias("quote"), F.col("text").alias("audit_body"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("side", "pos"))
    return qa.unionByName(ck).withColumn("index", number).drop("side", "pos")


def groundedness(claims: DataFrame) -> DataFrame:
    """(query_id, groundedness, unsupported) of audited claims (query_id, claim, verdict); blank claims don't count, and an audit without a claim gives 1."""
    real = tx.strip(tx.text_or_empty(F.col("claim"))) != ""
    ok = F.when(real, F.upper(tx.strip(tx.text_or_empty(F.col("verdict")))) == "SUPPORTED")
    return claims.withColumn("ok", ok).groupBy("query_id").agg(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(1.0)).alias("groundedness"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("claim")))).alias("unsupported"))


def finish(drafts: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Final answers of drafts (query_id, route, confidence, text, cited, groundedness, n_sources, audit_failed).

    A draft is refused, with its reason, when its route was, when it has no source or no text, when it is
    the sentinel, when the audit failed, or when too little of it is grounded.
    """
    low = F.coalesce(F.col("groundedness"), F.lit(1.0)) < cfg.groundedness_min
    reason = (
        F.when(F.col("route") == "refused", "route")
        .when(F.coalesce("n_sources", F.lit(0)) == 0, "no usable sources")
        .when(F.col("text").isNull(), "generation failed")
        .when(is_insufficient(F.col("text")), "insufficient context")
        .when(strip_sentinel(F.col("text")) == "", "nothing left")
        .when((F.col("audit_failed") if "audit_failed" in drafts.columns else F.lit(False)), "audit failed")
        .when(low, "not grounded")
    )
    out = drafts.withColumn("refusal_reason", reason).withColumn("answered", reason.isNull())
    out = out.withColumn("answer", F.when(F.col("answered"), strip_sentinel(F.col("text"))).otherwise(F.lit(REFUSAL)))
    return out.withColumn("uncertainty", F.round(tx.uncertainty(F.col("confidence"), F.col("groundedness"), F.col("answered")), 4))


def citations(done: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, citations): records of the sources that an answer cites, numbered as in its text."""
    cited = done.select("query_id", F.posexplode("cited").alias("at", "index"))
    rows = cited.join(found, ["query_id", "index"]).withColumn("record", F.struct((F.col("at") + 1).alias("index"), "doc_name", "page_label", "quote", "section", "origin"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list("record")).alias("citations"))


def near_misses(outcomes: DataFrame, pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, near_misses): for refused queries, the questions and passages that came closest, up to three of each."""
    refused = outcomes.where("route = 'refused'")
    label = tx.page_label(F.col("page_start"), F.col("page_end"))
    asked = refused.select("query_id", F.posexplode("qa_keys").alias("at", "qa_id")).join(pairs, "qa_id").select("query_id", F.lit(0).alias("side"), "at", F.concat(F.lit("Q: "), F.col("question"), F.lit(" — "), tx.citation(F.col("doc_name"), label)).alias("line"))
    said = refused.select("query_id", F.posexplode("chunk_keys").alias("at", "chunk_id")).join(chunks, "chunk_id").select("query_id", F.lit(1).alias("side"), "at", F.concat(F.lit("Passage: "), tx.citation(F.col("doc_name"), label)).alias("line"))
    lines = asked.unionByName(said).where("at < 3")
    return lines.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "at", "line"))), lambda x: x["line"]).alias("near_misses"))


def notes(cfg: EngineConfig = EngineConfig()) -> Column:
    """What a reader of a final answer should know, in order."""
    none = F.array().cast("array<string>")
    said = lambda when, *parts: F.when(when, F.array(F.concat(*parts))).otherwise(none)
    share = F.format_string("%.0f%%", 100 * F.col("groundedness"))
    uncited_ = F.transform(F.slice(uncited(F.col("answer")), 1, 3), lambda p: F.concat(F.lit("Uncited sentence: "), p))
    unsupported = F.transform(F.slice(F.coalesce("unsupported", none), 1, 5), lambda c: F.concat(F.lit("Unsupported claim: "), c))
    reason = F.col("refusal_reason")
    return F.concat(
        said(F.col("answered") & (F.size(F.coalesce("cited", F.array().cast("array<int>"))) == 0), F.lit("The answer cites no source.")),
        said(F.col("answered") & (strip_sentinel(F.col("text")) != tx.strip(tx.text_or_empty(F.col("text")))), F.lit("Only part of the question is answered.")),
        F.when(F.col("answered"), uncited_).otherwise(none),
        said(F.col("answered") & may_skip_audit(cfg), F.lit("Not audited: a sure hit of the question bank.")),
        said(F.coalesce(reason == "audit failed", F.lit(False)), F.lit("A draft could not be audited and is withheld.")),
        said(F.coalesce(reason == "not grounded", F.lit(False)), F.lit("Of a draft only "), share, F.lit(" was supported; it is withheld.")),
        F.when(F.coalesce(reason == "not grounded", F.lit(False)), unsupported).otherwise(none),
        said(F.coalesce(~reason.isin("audit failed", "not grounded"), F.lit(False)), F.lit("Refused: "), reason),
    )


def may_skip_audit(cfg: EngineConfig = EngineConfig()) -> Column:
    """Whether an answer from the bank is sure enough to need no audit."""
    return F.lit(cfg.skip_audit) & (F.col("route") == "question_bank") & (F.col("confidence") >= cfg.skip_audit_from)
