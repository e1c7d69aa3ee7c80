"""Language identification by a byte convolutional network.

Texts become windows of a fixed number of bytes (zero-padded at the end). A window's bytes are
embedded, convolved by filters of several widths, max-pooled over the window and classified by a
softmax layer. The network is trained in numpy by Adam on a bounded sample of labelled rows and
applied to every window of every text; a document's probabilities are the mean over its windows.
For prediction, embedding and filters are folded into tables indexed by byte pairs.

Bound: the sample takes SAMPLE_DOCS labelled documents of each language, those of least hash, with all
windows of their whole texts. Everything else is read whole.

Cases: a null or empty text, or one without a letter, is `und` with score 0; very long texts are windows
like all others, a piece of them at a time; rows that repeat score alike; null labels teach nothing; with
no labelled row at all every text is `und`; one label gives that label with score 1; ties at the sample's
edge go to the lesser text, ties of languages to the lesser name; columns named like the outputs are
replaced, others are kept; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytekit import pieces, raw, release
from lodestone.llm.store import small_batches

#: Bytes in a window, embedding size, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 12, (2, 3, 4), 12
#: The training sample's bound: documents of each language.
SAMPLE_DOCS = 100
UNDETERMINED = "und"

#: A-Z fold onto a-z; all else keeps its own code.
FOLD = np.arange(256, dtype=np.int64)
FOLD[65:91] += 32


@dataclass
class Network:
    """Weights of a trained network."""

    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses by byte pair (first pair of each width), by last byte (width 3), by second pair (width 4)."""
        e, (w2, w3, w4) = self.embed, self.filters
        part = lambda w, k: (e @ w[k * EMBED : (k + 1) * EMBED]).astype(np.float32)
        pair = lambda w, k: part(w, k)[:, None] + part(w, k + 1)[None]
        first = np.concatenate([pair(w, 0) for w in (w2, w3, w4)], axis=2).reshape(65536, -1)
        return np.ascontiguousarray(first), part(w3, 2), np.ascontiguousarray(pair(w4, 2).reshape(65536, -1))


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the rows, and the row of each; an empty row has none."""
    n = (np.diff(offsets) + WINDOW - 1) // WINDOW
    row = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    flat = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    shift = np.repeat(first * WINDOW - offsets[:-1], np.diff(offsets))
    flat[np.arange(offsets[0], offsets[-1]) + shift] = data
    return flat.reshape(-1, WINDOW), row


def train(texts: list[bytes], labels: list[str], epochs: int = 6, seed: int = 7) -> Network:
    """Fit the network to labelled texts; rows are put in a fixed order first, so input order is irrelevant."""
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
    names = sorted(set(labels))
    data, offsets = raw(pa.array([texts[i].decode("utf-8", "ignore") for i in order], pa.large_string()))
    x, row = windows_of(data, offsets)
    y = np.array([names.index(labels[i]) for i in order])[row]
    x = FOLD[x]
    rng = np.random.default_rng(seed)
    f = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "b": np.zeros(f), "d": rng.normal(0, 0.3, (f, len(names))), "o": np.zeros(len(names))}
    p |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y].astype(np.float32)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            xb, yb, n = x[at], y[at], len(at)
            emb, pooled, where, cols = p["e"][xb], [], [], []
            for w in WIDTHS:
                col = np.concatenate([emb[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
                r = col @ p[f"w{w}"]
                arg = r.argmax(1)
                pooled.append(np.take_along_axis(r, arg[:, None], 1)[:, 0])
                where.append(arg)
                cols.append(col)
            z = np.concatenate(pooled, 1) + p["b"]
            h = np.maximum(z, 0)
            s = h @ p["d"] + p["o"]
            s = np.exp(s - s.max(1, keepdims=True))
            g = s / s.sum(1, keepdims=True)
            g[np.arange(n), yb] -= 1
            g *= weight[at][:, None] / n
            grads = {"d": h.T @ g, "o": g.sum(0)}
            gz = (g @ p["d"].T) * (z > 0)
            grads["b"], ge = gz.sum(0), np.zeros_like(p["e"])
            for k, w in enumerate(WIDTHS):
                gk = gz[:, k * FILTERS : (k + 1) * FILTERS]
                picked = np.take_along_axis(cols[k], where[k][:, :, None], 1)
                grads[f"w{w}"] = np.einsum("nfe,nf->ef", picked, gk)
                back = gk[:, :, None] * p[f"w{w}"].T[None]
                for j in range(w):
                    np.add.at(ge, np.take_along_axis(xb, where[k] + j, 1), back[:, :, j * EMBED : (j + 1) * EMBED])
            grads["e"] = ge
            step += 1
            for k, gr in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * gr
                m2[k] = 0.999 * m2[k] + 0.001 * gr * gr
                p[k] -= (0.005 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(names, p["e"], [p[f"w{w}"] for w in WIDTHS], p["b"], p["d"], p["o"])


class Predictor:
    """A network folded into lookup tables."""

    def __init__(self, net: Network):
        self.net, (self.first, self.third, self.second) = net, net.tables()

    def window_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows."""
        out, f = np.empty((len(x), len(self.net.labels)), np.float32), FILTERS
        for a in range(0, len(x), 128):
            b = FOLD[x[a : a + 128]]
            pair = (b[:, :-1] << 8) | b[:, 1:]
            r = self.first.take(pair, axis=0)
            p2 = r[:, :, :f].max(1)
            r3 = r[:, :-1, f : 2 * f]
            r3 += self.third.take(b[:, 2:], axis=0)
            r4 = r[:, :-2, 2 * f :]
            r4 += self.second.take(pair[:, 2:], axis=0)
            z = np.maximum(np.concatenate([p2, r3.max(1), r4.max(1)], 1) + self.net.bias, 0) @ self.net.dense + self.net.out
            z = np.exp(z - z.max(1, keepdims=True))
            out[a : a + 128] = z / z.sum(1, keepdims=True)
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean class probabilities of each row's windows (zeros for an empty row)."""
        total = np.zeros((len(offsets) - 1, len(self.net.labels)))
        for a, b in pieces(offsets, 1 << 20):
            x, row = windows_of(data[offsets[a] : offsets[b]], offsets[a : b + 1])
            if len(x):
                p = self.window_probabilities(x)
                heads = np.flatnonzero(np.diff(row, prepend=-1))
                total[a + row[heads]] = np.add.reduceat(p.astype(np.float64), heads, axis=0) / np.diff([*heads, len(row)])[:, None]
        return total.round(6)  # beyond that, sums depend on which texts share a batch


def training_sample(docs: DataFrame, taught: Column, sample_docs: int = SAMPLE_DOCS) -> tuple[list[bytes], list[str]]:
    """Texts and languages of at most sample_docs labelled rows of each language, those of least hash, whole.

    Counts come from narrow columns first, so that about as many rows as needed are fetched.
    """
    known = docs.where(taught & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    spread = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    limit = F.lit(0).cast("long")
    for lang, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * 1.3 * sample_docs / n) + (1 << 22)))).otherwise(limit)
    rows = known.where(spread < limit).select("lang", spread.alias("h"), "text").collect()
    taken: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["text"])):
        own = taken.setdefault(r["lang"], [])
        if len(own) < sample_docs:
            own.append(r["text"].encode())
    pairs = [(t, k) for k, v in taken.items() for t in v]
    return [t for t, _ in pairs], [k for _, k in pairs]


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether the row's id falls in the fold that teaches nothing."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold


def fit(docs: DataFrame, taught: Column, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """A network trained on a bounded sample of the rows that `taught` selects; None without labels."""
    texts, labels = training_sample(docs, taught, sample_docs)
    return train(texts, labels) if texts else None


def identify(docs: DataFrame, net: Network | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its probability; columns of those names are replaced."""
    if net is None:
        return docs.withColumns({pred: F.lit(UNDETERMINED), score: F.lit(0.0)})
    from pyspark.sql import types as T

    base = docs.withColumn("__letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    keep = [f for f in docs.schema.fields if f.name not in (pred, score)]
    schema = T.StructType([*keep, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor, names = Predictor(net), np.array([*net.labels, UNDETERMINED], object)
        for b in batches:
            p = predictor.documents(*raw(b.column(text)))
            best = p.argmax(1)
            value = p[np.arange(len(p)), best]
            letters = np.asarray(b.column("__letter").to_numpy(zero_copy_only=False), bool)
            best[~letters], value[~letters] = len(net.labels), 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(names[best].tolist(), pa.string()), pa.array(np.minimum(value, 1.0))], names=schema.names)
        release()

    return small_batches(base).mapInArrow(run, schema)


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    net = fit(rows, ~F.col("held_out"))
    return identify(rows.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", "lang_pred", "score")
