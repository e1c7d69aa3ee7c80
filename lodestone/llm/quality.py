"""Quality rules with risk-controlled thresholds.

Four signals are ratios of the base counts of a text: symbols a word, share of repeated lines, share of
words in repeated 3-word windows, and characters a word. A signal rejects a text above a cutoff. For
each stratum (language) and signal, the cutoffs of a fixed grid are tested from lenient to strict on the
labelled texts of good quality: the hypothesis that the cutoff rejects more than its share of the allowed
risk is refuted if the exact binomial probability of seeing so few rejections is small. Testing stops at
the first cutoff that isn't refuted (fixed sequence), and the error level is divided over strata and
signals (Bonferroni), so with probability 1 - DELTA no stratum loses more than RISK of its good texts. Of
the certified cutoffs the one that rejects the most bad texts over good ones is used, if there is any.

Everything is DataFrame functions. Cases: a null or empty text has zero counts and fails the base rule; a
stratum without labels, or with too few to certify anything, has no cutoffs; null languages are a stratum;
a document labelled more than once counts as good only if all its labels say so; very long texts are counted
whole; rows that repeat are judged alike; of cutoffs that reject equally many more bad texts than good ones
the most lenient is used; columns named like the outputs are replaced, others are kept; empty tables give
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.store import join_small, written

#: Good texts that a stratum may lose at most, and the chance of losing more.
RISK, DELTA = 0.02, 0.05
#: Cutoffs from lenient to strict.
GRID = {
    "symbols": (4.0, 3.0, 2.5, 2.0, 1.5, 1.25, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "lines": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeats": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "length": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0),
}
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c != text]
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select(*rest, words.alias("__w"), lines.alias("__l"), F.length(F.translate(t, SPACE, "")).alias("word_chars"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"))
    windows = F.when(F.size("__w") >= 3, F.transform(F.slice("__w", 1, F.size("__w") - 2), lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    cut = cut.select("*", windows.alias("__h"))
    # only texts in which a window recurs need its places: equal windows stand side by side once sorted
    sorted_h = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    cut = cut.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), sorted_h))
    same = lambda s, i, d: F.coalesce(F.get("__s", i + d)["h"] == s["h"], F.lit(False))
    hits = F.filter("__s", lambda s, i: same(s, i, -1) | same(s, i, 1))
    places = F.flatten(F.transform(hits, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))
    return cut.select(
        *rest,
        F.size("__w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        F.when(F.col("__s").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(places))).cast("long").alias("n_repeat_words"),
    )


def signals() -> dict[str, Column]:
    """The signals of a row with base counts."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / words,
        "lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeats": F.col("n_repeat_words") / words,
        "length": F.col("word_chars") / words,
    }


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ln_factorial(n: Column) -> Column:
    """ln n!: the sum itself below 30, else Stirling's series, exact to double precision."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(30)).cast("int")), F.lit(0.0), lambda a, i: a + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0))
    large = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 30, small).otherwise(large)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X(n, p); 1 where k is beyond the mean (never significant).

    Terms are summed downwards from k; those over ten deviations lower are below double precision.
    """
    first = F.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * F.lit(math.log(p)) + (n - k) * F.lit(math.log1p(-p)))
    many = F.least(k, (50 + F.ceil(10 * F.sqrt(n * p))).cast("long")).cast("int")
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), many), start, step, lambda a: a["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))


def cutoffs(counts: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each stratum with labels: the certified cutoff of each signal, or null."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = counts.where(~base_failed()).join(marks, "doc_id").select(F.col(stratum).alias("stratum"), (F.col("quality") != 0).alias("good"), *(s.alias(k) for k, s in signals().items()))
    each = [(k, i, c) for k, grid in GRID.items() for i, c in enumerate(grid)]
    sums = [F.count_if(F.col("good") & (F.col(k) > c)).alias(f"g_{k}_{i}") for k, i, c in each] + [F.count_if(~F.col("good") & (F.col(k) > c)).alias(f"b_{k}_{i}") for k, i, c in each]
    wide = known.groupBy("stratum").agg(F.count_if("good").alias("n"), *sums)
    long = wide.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.lit(i).alias("place"), F.lit(c).alias("cutoff"), F.col(f"g_{k}_{i}").alias("good"), F.col(f"b_{k}_{i}").alias("bad")) for k, i, c in each))).alias("t")).select("stratum", "n", "t.*")
    strata = F.count_if((F.col("signal") == "symbols") & (F.col("place") == 0)).over(Window.partitionBy(F.lit(0)))
    level = F.lit(delta) / (len(GRID) * strata)
    p = F.when(F.col("n") > 0, binomial_tail(F.col("good"), F.col("n"), risk / len(GRID))).otherwise(1.0)
    in_turn = Window.partitionBy("stratum", "signal").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tested = long.withColumn("level", level).withColumn("p", p).withColumn("certified", F.max("p").over(in_turn) <= F.col("level"))
    gain = F.col("bad") - F.col("good")
    best = tested.where(F.col("certified") & (gain > 0)).groupBy("stratum", "signal").agg(F.max_by("cutoff", F.struct(gain.alias("gain"), -F.col("place"))).alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("signal") == k, F.col("cutoff"))).alias(f"max_{k}") for k in GRID))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs without the text, with the base counts, base_failed and kept; columns of those names are replaced."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "kept")
    names = [c for c in docs.columns if c != text and c not in made]
    counts = written(base_counts(docs.select(*names, text).withColumn("__stratum", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))), text), "quality")
    table = written(cutoffs(counts, labels, "__stratum", risk, delta).withColumnRenamed("stratum", "__stratum"), "cutoffs")
    over = F.lit(False)
    for k, s in signals().items():
        over = over | F.coalesce(s > F.col(f"max_{k}"), F.lit(False))
    out = join_small(counts, table, ["__stratum"])
    return out.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed and kept of every document."""
    return judge(docs.select("doc_id", "lang", "text"), labels).drop("lang")


def quality_sql() -> str:
    """The same for DuckDB."""
    share = {"symbols": "n_symbols / greatest(n_words, 1)::double", "lines": "n_dup_lines / greatest(n_lines, 1)::double", "repeats": "n_repeat_words / greatest(n_words, 1)::double", "length": "word_chars / greatest(n_words, 1)::double"}
    grid = ", ".join(f"('{k}', {i}, {c!r}::double)" for k, g in GRID.items() for i, c in enumerate(g))
    p = RISK / len(GRID)
    values = " union all ".join(f"select stratum, good, '{k}' as signal, {k} as value from known" for k in GRID)
    over = " or ".join(f"coalesce({s} > m.max_{k}, false)" for k, s in share.items())
    return f"""
with w as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
b as (select doc_id, lang, coalesce('=' || lang, '') as stratum, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, words from w),
g as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from b where len(words) >= 3),
h as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from g),
rep as (select doc_id, count(distinct j)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from h where n > 1) group by doc_id),
f as (select b.doc_id, lang, stratum, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from b left join rep using (doc_id)),
e as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
marks as (select doc_id, min(quality) as quality from labels where quality is not null group by doc_id),
known as (select stratum, quality <> 0 as good, {", ".join(f"{s} as {k}" for k, s in share.items())} from e join marks using (doc_id) where not base_failed),
v as ({values}),
grid(signal, place, cutoff) as (values {grid}),
c as (select stratum, signal, place, cutoff, count(*) filter (good) as n, count(*) filter (good and value > cutoff) as k, count(*) filter (not good and value > cutoff) as bad from v join grid using (signal) group by all),
q as (select *, case when n = 0 or k > n * {p!r} then 1.0 else least(1.0, (select sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({p!r}) + (n - j) * ln(1 - {p!r}))) from (select unnest(range(0, k + 1)) as j))) end as pv from c),
x as (select *, max(pv) over (partition by stratum, signal order by place) <= {DELTA!r} / ({len(GRID)} * (select count(distinct stratum) from c)) as certified from q),
best as (select stratum, signal, arg_max(cutoff, (bad - k) * 1000 - place) as cutoff from x where certified and bad > k group by stratum, signal),
m as (select stratum, {", ".join(f"max(cutoff) filter (signal = '{k}') as max_{k}" for k in GRID)} from best group by stratum)
select e.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({over}) as kept from e left join m using (stratum)
"""
