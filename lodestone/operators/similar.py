"""Near-duplicate texts by the Jaccard similarity of their word sets, as joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions import text as tx
from lodestone.sources import scratch

#: Words whose frequency every task knows, sets that are compared at a time, and longs of a set's signature.
FREQUENT, BLOCK, LONGS = 1 << 17, 2048, 8


def word_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, set_id, n, words): each text's distinct words, sorted, and their digest."""
    rows = tx.composed(scratch.spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))), "text")
    rows = rows.select("key", F.sort_array(F.array_distinct(tx.tokens(F.col("text")))).alias("words"))
    return rows.select("key", F.sha2(F.array_join("words", " "), 256).alias("set_id"), F.size("words").alias("n"), "words")


def hashed(salt: int) -> Column:
    """The numbers of a set's words, in no order."""
    return F.transform("words", lambda w: F.xxhash64(F.lit(salt), w))


def frequent(sets: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(salt, numbers, df) of the most frequent words, at most FREQUENT of them, sorted by number. No two words have the same number under the salt."""
    words = scratch.written(sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), "vocabulary")
    salt = 0
    while not words.groupBy(F.xxhash64(F.lit(salt), "word").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        salt += 1
    least = left = None
    for df, n in words.where("df > 1").groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).toLocalIterator():
        left = (FREQUENT if left is None else left) - n
        if left < 0:
            break
        least = df
    if least is None:
        return salt, np.empty(0, np.int64), np.empty(0, np.int64)
    rows = words.where(F.col("df") >= least).select(F.xxhash64(F.lit(salt), "word").alias("h"), "df").toArrow()
    h, df = rows.column("h").to_numpy(), rows.column("df").to_numpy()
    order = np.argsort(h)
    return salt, h[order], df[order]


def _first_words(known: np.ndarray, df: np.ndarray, percent: int) -> Callable:
    """Rows (id, h) as (id, n, place, word): the words that links() needs of each set, the rarest ones first; those that aren't known are rarer than any that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            h = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            times = np.where(known[at] == h, df[at], 0) if len(known) else np.zeros(len(h), np.int64)
            order = np.lexsort((h, times, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = place < (sizes - -(-percent * sizes // 100) + 1)[row]
            ids = batch.column("id").to_numpy()[row[kept]]
            yield pa.RecordBatch.from_pydict({"id": ids, "n": sizes[row[kept]].astype(np.int32), "place": place[kept].astype(np.int32), "word": h[order][kept]})

    return run


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h) as (id, n, s0, s1, …): of each bit whether an odd number of the set's words fall on it."""
    for batch in batches:
        lists = batch.column("h")
        h, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        odd = np.bincount(row * 64 * LONGS + (h & (64 * LONGS - 1)), minlength=len(sizes) * 64 * LONGS).astype(np.uint8) & 1
        bits = np.packbits(odd).view(np.int64).reshape(-1, LONGS)
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": sizes.astype(np.int32)} | {f"s{k}": bits[:, k] for k in range(LONGS)})


def _compared(percent: int) -> Callable:
    """Pairs (a, b) and the sets (id, h) that they name, as those pairs that link."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        ids = sets.column("id").to_numpy()
        lists = sets.column("h").combine_chunks()
        words, sizes = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1], np.diff(lists.offsets.to_numpy())
        order = np.argsort(ids)
        starts = (np.cumsum(sizes) - sizes)[order]
        ids, sizes = ids[order], sizes[order]
        a, b = (np.searchsorted(ids, pairs.column(c).to_numpy()) for c in "ab")
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        mark, links = np.zeros(int(words.max()) + 1 if len(words) else 0, bool), np.zeros(len(a), bool)
        cuts = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
        for x, y in zip(cuts, cuts[1:]):
            one = words[starts[a[x]] : starts[a[x]] + sizes[a[x]]]
            mark[one] = True
            for k in range(x, y):
                both = np.count_nonzero(mark[words[starts[b[k]] : starts[b[k]] + sizes[b[k]]]])
                links[k] = 100 * both >= percent * (sizes[a[k]] + sizes[b[k]] - both)
            mark[one] = False
        return pa.table({"a": ids[a[links]], "b": ids[b[links]]})

    return run


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: ids of different sets (id, n, words) of which 100 * intersection >= percent * union.

    Two such sets share one of their first n - ceil(percent n / 100) + 1 words at least, in any order of all
    words; in order of frequency these are the rarest. So an equi-join on these words finds every pair,
    and only its pairs are compared whole. Words are numbers that no two share. The order is made within each
    row, from the frequencies of the most frequent words. Where the first word that two sets share stands too late
    in them for all the words that a link needs, there is no pair; nor where the bits on which odd numbers of their
    words fall differ too often, as each takes a word that only one of them has. A pair is compared under the least number that its
    first words share, which near copies have in common, and a set goes there once, not once for each of its pairs.
    """
    salt, known, df = frequent(sets)
    numbers = sets.where("n > 0").select("id", hashed(salt).alias("h"))
    first = scratch.written(numbers.mapInArrow(_first_words(known, df, percent), "id long, n int, place int, word long"), "first-words")
    x, y = (first.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("place").alias(f"p_{c}"), "word") for c in "ab")
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = x.join(y, "word").where((F.col("a") < F.col("b")) & sized)
    # words that are shared before this one are at most as many as there are places before it
    most = F.least("p_a", "p_b") + F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    pairs = pairs.where(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most))
    pairs = pairs.groupBy("a", "b").agg(F.min("word").alias("word"))
    bits = [f"s{k}" for k in range(LONGS)]
    signed = scratch.written(numbers.mapInArrow(_signatures, f"id long, n int, {', '.join(f'{c} long' for c in bits)}"), "signatures")
    for e in "ab":
        pairs = pairs.join(signed.select(F.col("id").alias(e), F.col("n").alias(f"n_{e}"), *(F.col(c).alias(f"{c}_{e}") for c in bits)), e)
    apart, total = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits), F.col("n_a") + F.col("n_b")
    pairs = scratch.written(pairs.where(100 * (total - apart) >= percent * (total + apart)).select("a", "b", "word"), "pairs")
    ends = lambda t, *by: t.select(*by, F.explode(F.array("a", "b")).alias("id")).distinct()
    blocks = ends(pairs, "word").groupBy("word").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    pairs = pairs.join(blocks, "word").select("a", "b", "word", block("a").alias("i"), block("b").alias("j"))
    named = ends(pairs, F.col("word").alias("w"), F.col("i").alias("k"), F.col("j").alias("l")).join(numbers, "id").select("w", "k", "l", "id", "h")
    return pairs.groupBy("word", "i", "j").cogroup(named.groupBy("w", "k", "l")).applyInArrow(_compared(percent), "a long, b long")


def near_duplicates(docs: DataFrame, key: str, text: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(key, same_as, n_links): the least key with an equal word set, and how many other sets are near it.

    Texts with equal sets are one node, so a group of copies makes no pairs.
    """
    all_ = scratch.written(word_sets(docs, key, text), "word-sets")
    sets = all_.groupBy("set_id").agg(F.min("key").alias("same_as"), F.first("n").alias("n"), F.first("words").alias("words"))
    sets = scratch.written(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    ends = links(sets, round(100 * cfg.answer_jaccard)).select(F.explode(F.array("a", "b")).alias("id"))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    named = sets.select("id", "set_id", "same_as").join(counts, "id", "left")
    return all_.select("key", "set_id").join(named, "set_id").select("key", "same_as", F.coalesce("n_links", F.lit(0)).alias("n_links"))
