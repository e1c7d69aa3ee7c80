"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 4 to 6 characters (code points, lower-cased) that a text holds, hashed into
2**BITS places; n-grams that fall in one place are one feature. Every place that the sample touches is a
feature: it gets the log ratio of its smoothed frequencies in toxic and other texts, and a logistic
regression is fitted to the features scaled by these ratios. The product of ratio and weight is one
table, so a text's score is a sum of table entries over the distinct features that it holds.

Bound: the sample takes SAMPLE_DOCS labelled documents of each class, those of least hash, with their
whole texts. Everything else is read whole.

Cases: a null or empty text, or one shorter than an n-gram, has no features and scores by the intercept
alone; very long texts are scored whole, one at a time; rows that repeat score alike; a document labelled
more than once is toxic if one label is; null labels and labels without a document teach nothing; with no
label, or labels of one kind only, the intercept is the smoothed share of toxic labels; ties at the
sample's edge go to the lesser text; a column named like the score is replaced, others are kept; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytekit import raw, release
from lodestone.llm.store import small_batches

#: Lengths of n-grams, and bits of a feature's hash.
LENGTHS, BITS = (4, 5, 6), 20
#: The training sample's bound: documents of each class.
SAMPLE_DOCS = 500
#: Texts added to the counts of each side before ratios are taken: an n-gram that few texts hold says little.
SMOOTHING = 20
#: Code points below this are lower-cased, where the lower case is one code point.
CASED = 0x2200


def _lower() -> np.ndarray:
    low = [chr(c).lower() for c in range(CASED)]
    out = np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32)
    out[[9, 10, 11, 12, 13]] = 32
    return out


FOLD = _lower()


@dataclass
class Classifier:
    """Intercept and the weight of each hashed feature (zero: not a feature)."""

    intercept: float
    weight: np.ndarray


def characters(text: bytes) -> np.ndarray:
    """The folded code points of UTF-8 bytes."""
    x = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    small = x < CASED
    return np.where(small, FOLD[np.where(small, x, 0)], x)


def hashed(x: np.ndarray) -> np.ndarray:
    """Places of all n-grams of a text's folded code points."""
    h, found = x * np.uint32(0x9E3779B1), []
    for k in range(1, max(LENGTHS)):
        if len(x) <= k:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[k:] * np.uint32(0x9E3779B1)
        if k + 1 in LENGTHS:
            found.append(((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


class Features:
    """The distinct features of texts, one text after the other."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: bytes) -> np.ndarray:
        code = hashed(characters(text))
        at = np.arange(len(code), dtype=np.int32)
        self.last[code] = at
        return code[self.last[code] == at]


def log_ratios(toxic: np.ndarray, other: np.ndarray, toxic_texts: float, other_texts: float) -> np.ndarray:
    """Log ratio of each feature's smoothed share of toxic and of other texts, from the numbers of texts that hold it."""
    share = lambda n, of: np.log((n + SMOOTHING) / (of + 2 * SMOOTHING))
    return share(toxic, toxic_texts) - share(other, other_texts)


def train(texts: list[str], labels: list[int], rounds: int = 60, strength: float = 1e-4, step: float = 10.0) -> Classifier:
    """Fit ratios and weights; the rows are put in a fixed order first."""
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
    y = np.array([labels[i] for i in order], np.float64)
    weight = np.zeros(1 << BITS, np.float32)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return Classifier(float(np.log(prior / (1 - prior))), weight)
    features = Features()
    codes = [features(texts[i].encode("utf-8", "replace")) for i in order]
    size = np.array([len(c) for c in codes])
    keep, col = np.unique(np.concatenate(codes), return_inverse=True)
    codes, row = [], np.repeat(np.arange(len(y), dtype=np.int32), size)
    col = col.astype(np.int32)
    toxic = np.bincount(col, y[row], len(keep))
    # sums by text run over the pairs as they are, sums by feature over the pairs sorted by feature
    full = np.flatnonzero(size)
    text_starts = np.concatenate([[0], np.cumsum(size)])[full]
    rows_by_feature = row[np.argsort(col, kind="stable")]
    feature_starts = np.concatenate([[0], np.cumsum(np.bincount(col, minlength=len(keep)))[:-1]]) if len(keep) else np.zeros(0, np.int64)

    def by_text(value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y))
        if len(full):
            out[full] = np.add.reduceat(value[col], text_starts)
        return out

    def by_feature(value: np.ndarray) -> np.ndarray:
        return np.add.reduceat(value[rows_by_feature], feature_starts) if len(keep) else np.zeros(0)

    ratio = log_ratios(toxic, np.bincount(col, minlength=len(keep)) - toxic, y.sum(), len(y) - y.sum())
    # a text's scaled features have length 1 on average, so that one step suits all samples
    scale = ratio / max(1e-9, float(np.sqrt(by_text(ratio * ratio).mean())))
    w, b = np.zeros(len(keep)), float(np.log(prior / (1 - prior)))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    speed, speed_b = np.zeros_like(w), 0.0
    for _ in range(rounds):
        z = by_text(scale * w) + b
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        speed = 0.9 * speed + scale * by_feature(g) + strength * w
        speed_b = 0.9 * speed_b + g.sum()
        w, b = w - step * speed, b - step * speed_b
    weight[keep] = w * scale
    return Classifier(float(b), weight)


def training_sample(docs: DataFrame, labels: DataFrame, taught: Column, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most sample_docs rows of each class, those of least hash, whole.

    A document labelled more than once counts as toxic if one of its labels is.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(taught).withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)))
    counts = {int(r["toxic"] != 0): r["n"] for r in marks.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.lit(0).cast("long")
    for kind, n in counts.items():
        limit = F.when((F.col("toxic") != 0).cast("int") == kind, F.lit(min(1 << 30, int((1 << 30) * 1.3 * sample_docs / n) + (1 << 22)))).otherwise(limit)
    picked = marks.where(F.col("h") < limit).select("doc_id", "toxic", "h")
    ids = [(r["doc_id"], int(r["toxic"] != 0), r["h"]) for r in picked.collect()]
    if not ids:
        return [], []
    kind = {i: (h, t) for i, t, h in ids}
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).where(F.col("doc_id").isin(list(kind))).collect()
    taken: dict[int, list[str]] = {0: [], 1: []}
    for h, r in sorted(((kind[r["doc_id"]], r) for r in rows), key=lambda x: (x[0], x[1]["text"])):
        if len(taken[h[1]]) < sample_docs:
            taken[h[1]].append(r["text"])
    return [*taken[0], *taken[1]], [0] * len(taken[0]) + [1] * len(taken[1])


def fit(docs: DataFrame, labels: DataFrame, taught: Column, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """A classifier trained on a bounded sample of the labelled rows that `taught` selects."""
    texts, marks = training_sample(docs, labels, taught, sample_docs)
    return train(texts, marks)


def score(docs: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of being toxic; a column of that name is replaced."""
    keep = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.DoubleType())])
    weight, intercept = model.weight, model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            data, offsets = raw(b.column(text))
            z = np.array([intercept + float(weight[features(data[i:j].tobytes())].sum(dtype=np.float64)) for i, j in zip(offsets[:-1], offsets[1:])])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(p, pa.float64())], names=schema.names)
        release()

    return small_batches(docs).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether the row's id falls in the fold that teaches nothing."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, ~held_out())
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
