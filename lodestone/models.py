"""Model-backed steps: what each must do, and deterministic stand-ins that need no model."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx


class Embedder(Protocol):
    """Unit vectors of texts; one vector for each text."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed hashed bag of words, normalised; blank texts are embedded as a space."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or " ").casefold()) or [" "]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[k, h % self.size] += 1 - 2 * (h >> 63)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def embed(rows: DataFrame, text: str, out: str, embedder: Embedder, optional: bool = False) -> DataFrame:
    """rows with a vector of each text, batch by batch; a wrong number of vectors is an error.

    optional: texts of a batch for which the embedder fails have no vector, instead of failing the job.
    """

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        try:
            got = embedder([t if t and t.strip() else " " for t in texts])
            if len(got) != len(texts):
                raise ValueError(f"{len(texts)} texts, but {len(got)} vectors")
        except Exception:  # whatever the embedder raises
            if not optional:
                raise
            got = [None] * len(texts)
        return pd.Series(got, dtype=object)

    return rows.withColumn(out, vectors(text))


def salvage_json(reply: str | None):
    """The JSON value in a model's reply: whole, fenced, or the first balanced braces; None without one."""
    text = re.sub(r"<think>.*?(?:</think>|\Z)", "", reply or "", flags=re.S).strip()
    tries = [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]
    decoder = json.JSONDecoder()
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            pass
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def raw_pairs(payload) -> list[dict]:
    """Pairs of any shape in which models return them: a list, {"pairs": [...]}, or one pair."""
    if isinstance(payload, dict):
        listed = next((v for v in payload.values() if isinstance(v, list) and v and isinstance(v[0], dict)), None)
        payload = listed if listed is not None else [payload]
    return [p for p in payload if isinstance(p, dict)] if isinstance(payload, list) else []


def sentence_extractor(chunks: DataFrame, per_chunk: int = 3) -> DataFrame:
    """Stand-in for mining questions: each chunk's first long sentences, asked for by their opening words."""
    parts = F.filter(F.split(tx.one_space(F.col("text")), r"(?<=[.!?])\s+"), lambda s: F.length(s) >= 40)
    rows = chunks.select("chunk_id", F.posexplode(F.slice(parts, 1, per_chunk)).alias("pos", "s"))
    opening = F.array_join(F.slice(F.split("s", " "), 1, 8), " ")
    words = F.array_distinct(F.filter(F.split(F.lower("s"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 6))
    return rows.select("chunk_id", "pos", F.concat(F.lit("What is said about "), opening).alias("question"), F.col("s").alias("answer"), F.lit("factual").alias("question_type"), F.lit("basic").alias("difficulty"), F.array("s").alias("evidence"), F.array(F.concat(F.lit("Tell me about "), opening)).alias("paraphrases"), F.slice(words, 1, 4).alias("keywords"))


RAW = "chunk_id string, pos int, question string, answer string, question_type string, difficulty string, evidence array<string>, paraphrases array<string>, keywords array<string>, error string"


def model_extractor(ask: Callable[[str, str, str], str], most: int = 7) -> Callable[[DataFrame], DataFrame]:
    """An extractor for Engine.ingest() that asks a model for the pairs of each chunk: ask(text, text before, text after) -> reply.

    chunks may have prev_text and next_text. A chunk for which the model fails gives one row with the error;
    one without a pair gives a row without a question.
    """
    texts = lambda v: [str(x) for x in v if x is not None] if isinstance(v, list) else []
    word = lambda v: None if v is None else str(v)

    def rows(chunk: str, reply: str) -> list[tuple]:
        found = [(chunk, k, word(p.get("question")), word(p.get("answer")), word(p.get("question_type")), word(p.get("difficulty")), texts(p.get("evidence")), texts(p.get("paraphrases")), texts(p.get("keywords")), None) for k, p in enumerate(raw_pairs(salvage_json(reply))[:most])]
        return found or [(chunk, 0, None, None, None, None, [], [], [], None)]

    def run(parts):
        for p in parts:
            out = []
            for chunk, text, before, after in zip(p.chunk_id, p.text, p.prev_text, p.next_text):
                try:
                    out += rows(chunk, ask(text, before or "", after or ""))
                except Exception as e:  # whatever the client raises; the batch goes on
                    out.append((chunk, 0, None, None, None, None, [], [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RAW.split(", ")])

    def extract(chunks: DataFrame) -> DataFrame:
        more = {c: F.lit(None).cast("string") for c in ("prev_text", "next_text") if c not in chunks.columns}
        return chunks.withColumns(more).select("chunk_id", "text", "prev_text", "next_text").mapInPandas(run, RAW)

    return extract


def complete(raw: DataFrame) -> DataFrame:
    """Raw pairs with the columns of RAW, in their order."""
    return raw.withColumn("error", F.lit(None).cast("string") if "error" not in raw.columns else F.col("error")).select(*(F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in RAW.split(", ")))


def with_retries(ask: Callable[..., str], tries: int = 3, wait: float = 1.0) -> Callable[..., str]:
    """A client that is asked again after a failure, after twice the time each time."""
    import time

    def again(*args: str) -> str:
        for k in range(tries):
            try:
                return ask(*args)
            except Exception:  # whatever the client raises; the last one goes on
                if k + 1 == tries:
                    raise
                time.sleep(wait * 2**k)
        raise ValueError("tries must be 1 or more")

    return again


def extractive_answer(sources: DataFrame) -> DataFrame:
    """Stand-in for generation: the quote of each query's first sources, each with its marker."""
    line = F.concat("quote", F.lit(" ["), F.col("index").cast("string"), F.lit("]"))
    return sources.where("index <= 3").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("l")))), lambda x: x["l"]), " ").alias("text"))


def containment_audit(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Stand-in for the audit: a sentence is supported if an audit text holds nine tenths of its words; an answer without a sentence gives one blank claim."""
    claims = answers.select("query_id", F.explode(F.split("text", r"(?<=[.!?…])\s+|\s*\[\d+\]\s*")).alias("claim"))
    texts = sources.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(tx.grounding_tokens(F.col("audit_body"))))).alias("known"))
    words = F.array_distinct(tx.grounding_tokens(F.col("claim")))
    held = F.size(F.array_intersect(words, "known")) >= 0.9 * F.size(words)
    return claims.join(texts, "query_id", "left").select("query_id", "claim", F.when(F.coalesce(held, F.lit(False)), "SUPPORTED").otherwise("UNSUPPORTED").alias("verdict"))
