"""Registered queries over the driver's tables, each with its SQL.

The tables aren't retrieval logs, so some play a part: `documents` are one-page documents and chunks,
`benchmark` passages are queries, `embeddings` are vectors of the documents of the same number, `label` is
a question's id, `source` is a document and `doc_id` its page, an event is a search, refused if it is an
error, and `quality` says that an answer is expected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import DIFFICULTIES, QUESTION_TYPES, EngineConfig
from lodestone.functions import text as tx
from lodestone.operators import answers, bank, chunker, dense, fusion, grounding, pages, records, router, similar, sparse
from lodestone.sources import files, scratch
from lodestone.sources.store import new_only, without
from lodestone.streaming import rollup

CFG = EngineConfig()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The same text functions in DuckDB's SQL.
SQL_SPACE = tx.SPACE.replace("\\x1c", "\\x{1c}").replace("\\x20", "\\x{20}")


#: Folds that the tables can need, for SQL; the engine's own are complete.
SQL_FOLDS = {"ß": "ss", "ſ": "s", "ς": "σ", "ŉ": "ʼn", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def sql_fold(c: str) -> str:
    out = f"lower(translate(regexp_replace(coalesce({c}, ''), '{tx.ARABIC_MARKS}', '', 'g'), '{tx.ARABIC_FROM}', '{tx.ARABIC_TO}'))"
    for a, b in SQL_FOLDS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all({sql_fold(c)}, '{tx.WORD}')"


def sql_one_space(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SQL_SPACE}+', ' ', 'g'))"


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with its SQL if there is any."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bm25_sql(asked: str = "select item_id as query_id, text from benchmark", limit: int = CFG.overfetch * CFG.vector_k) -> str:
    """Common tables of the index, and `sparse`: the best documents of each query asked."""
    return f"""
toks as materialized (select doc_id as key, {sql_tokens("text")} as ws from documents),
st as materialized (select count(*) as n, avg(len(ws)) as avgdl from toks),
po as materialized (select key, dl, term, count(*) as tf from (select key, len(ws) as dl, unnest(ws) as term from toks) group by all),
ra as materialized (select term, count(*) as df, ln((select n from st) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from po group by term),
me as materialized (select avg(raw) as mean from ra),
te as materialized (select term, df, case when raw < 0 then {CFG.bm25_epsilon} * mean else raw end as idf from ra cross join me),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({sql_tokens("text")}) as term from ({asked})) group by all),
sc as (select query_id, key, round(sum(qtf * idf * tf * {CFG.bm25_k1 + 1} / (tf + {CFG.bm25_k1} * (1 - {CFG.bm25_b} + {CFG.bm25_b} * dl / (select avgdl from st)))), 6) as score from qt join te using (term) join po using (term) group by query_id, key),
sparse as (select * from (select *, row_number() over (partition by query_id order by score desc, key) as rank from sc where score > 0) where rank <= {limit})
"""


BM25 = bm25_sql()
DENSE = f"""
dense as (select * from (select *, row_number() over (partition by query_id order by score desc, key) as rank from (
  select q.item_id as query_id, v.vec_id as key, round(greatest(0, least(1, list_dot_product(v.embedding::double[], e.embedding::double[]))), 6) as score
  from benchmark q join embeddings e on e.vec_id = q.item_id cross join embeddings v)) where rank <= {CFG.overfetch * CFG.vector_k})
"""
FUSED = f"""
un as (select query_id, key, max(d) as d, max(s) as s from (select query_id, key, score as d, null as s from dense union all select query_id, key, null, score from sparse) group by query_id, key),
tp as (select *, coalesce(max(s) over (partition by query_id), 0) as top, bool_or(d is not null) over (partition by query_id) as has_dense from un),
fu as (select query_id, key, round(case when top <= 0 then coalesce(d, 0) when not has_dense then coalesce(s, 0) / top else greatest(coalesce(d, 0), {CFG.dense_weight} * coalesce(d, 0) + {1 - CFG.dense_weight} * coalesce(s, 0) / top) end, 6) as score from tp),
fused as (select * from (select *, row_number() over (partition by query_id order by score desc, key) as rank from fu) where rank <= {CFG.vector_k})
"""


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    index = sparse.build(table(spark, d, "documents"), "doc_id", "text", CFG)
    return sparse.search(index, table(spark, d, "benchmark"), "item_id", "text", CFG.overfetch * CFG.vector_k, CFG)


def _dense(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    return dense.search(vectors, asked, "vec_id", "item_id", "embedding", CFG.overfetch * CFG.vector_k)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_dense(spark, d), _sparse(spark, d), CFG.vector_k, CFG)


@query(f"select doc_id, len(ws)::int as n_tokens, len(list_distinct(ws))::int as n_distinct from (select doc_id, {sql_tokens('text')} as ws from documents)")
def tokenize_documents(spark, d):
    ws = tx.tokens(F.col("text"))
    return scratch.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", ws.alias("ws")).select("doc_id", F.size("ws").alias("n_tokens"), F.size(F.array_distinct("ws")).alias("n_distinct"))


@query("select doc_id, substr(sha256(doc_id || '||0||' || substr(coalesce(text, ''), 1, 200)), 1, 20) as chunk_id, 'review_' || substr(sha256(" + sql_fold("source") + "), 1, 16) as review_id from documents")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.stable_id(F.col("doc_id"), F.lit(0), F.substring("text", 1, 200)).alias("chunk_id"), records.review_id(F.col("source")).alias("review_id"))


@query(
    f"""with t as (select doc_id, length({sql_one_space("text")}) as chars, regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g') as letters from documents),
r as (select doc_id, chars::int as chars, case when length(letters) = 0 then 0.0::double else (length(letters) - length(regexp_replace(letters, '{tx.RTL}', '', 'g')))::double / length(letters) end as rtl_ratio from t),
l as (select *, case when chars < {CFG.ocr_min_chars} then 'empty' when rtl_ratio > {CFG.ocr_rtl_ratio} then 'unreliable' else 'ok' end as layer from r)
select *, layer <> 'ok' as will_ocr from l"""
)
def text_layer_classify(spark, d):
    return pages.report(table(spark, d, "documents"), CFG).select("doc_id", "chars", "rtl_ratio", "layer", "will_ocr")


@query(f"with {BM25} select term, df, round(idf, 6) as idf from te")
def term_stats_bm25(spark, d):
    return sparse.build(table(spark, d, "documents"), "doc_id", "text", CFG).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {BM25} select query_id, key, score, rank::int as rank from sparse where rank <= 8")
def bm25_topk(spark, d):
    return _sparse(spark, d).where("rank <= 8").select("query_id", "key", "score", "rank")


@query(f"with {DENSE} select query_id, key, score, rank::int as rank from dense where rank <= {CFG.vector_k}")
def dense_topk(spark, d):
    return _dense(spark, d).where(F.col("rank") <= CFG.vector_k).select("query_id", "key", "score", "rank")


@query(f"with {DENSE} select query_id, key, score from dense where score >= {CFG.vector_threshold}")
def dense_threshold(spark, d):
    return _dense(spark, d).where(F.col("score") >= CFG.vector_threshold).select("query_id", "key", "score")


@query(f"with {BM25}, {DENSE}, {FUSED} select query_id, key, score, rank::int as rank from fused")
def hybrid_fuse_topk(spark, d):
    return _fused(spark, d).select("query_id", "key", "score", "rank")


@query(
    f"""with {BM25}, {DENSE}, al as (select query_id, key, rank, score from sparse union all select query_id, key, rank, score from dense),
r as (select query_id, key, round(sum(1.0::double / ({CFG.rrf_k} + rank)), 9) as rrf, max(score) as score from al group by query_id, key)
select query_id, key, rrf, score, rank::int as rank from (select *, row_number() over (partition by query_id order by rrf desc, score desc, key) as rank from r) where rank <= 12"""
)
def rrf_fuse(spark, d):
    both = _sparse(spark, d).select("query_id", "key", "rank", "score").unionByName(_dense(spark, d).select("query_id", "key", "rank", "score"))
    return fusion.reciprocal_ranks(both, 12, CFG)


@query(
    f"""with {BM25}, {DENSE}, {FUSED},
qb as (select query_id, max(score) as bq from dense group by 1), pb as (select query_id, max(score) as bp from fused group by 1),
ac as (select d.query_id, max(score) as ba from dense d join qb using (query_id) where bq >= {CFG.question_threshold} and score >= round(greatest(bq - {CFG.question_margin}, {CFG.question_threshold * CFG.floor_ratio}), 6) group by 1),
th as (select query_id, bp, case when bp >= {CFG.vector_threshold} then {CFG.vector_threshold} else greatest({CFG.vector_threshold * CFG.adaptive_ratio}, least({CFG.vector_threshold}, bp * 0.97)) end as threshold from pb),
n2 as (select f.query_id, count(*) as n from fused f join th using (query_id) where score >= threshold group by 1),
j as (select b.item_id as query_id, bq, bp, ba, threshold, ba is not null as one, n from benchmark b left join qb on qb.query_id = b.item_id left join th on th.query_id = b.item_id left join ac on ac.query_id = b.item_id left join n2 on n2.query_id = b.item_id),
k as (select *, one and ba >= {CFG.hybrid_ceiling} as sure, not coalesce(one and ba >= {CFG.hybrid_ceiling}, false) and coalesce(n, 0) > 0 as two from j)
select query_id, case when one and (sure or not two) then 'question_bank' when one and two then 'hybrid' when two then 'vector_rag' else 'refused' end as route,
round(case when one and (sure or not two) then ba when one then greatest(ba, bp) when two then bp else greatest(coalesce(bp, 0), coalesce(bq, 0)) end, 6) as confidence,
coalesce(threshold, {CFG.vector_threshold})::double as threshold from k"""
)
def route_decision(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    near = scratch.written(_dense(spark, d).select("query_id", "key", "score"), "dense")  # read by the fusion and as hits of the bank
    fused = fusion.fuse(near, _sparse(spark, d), CFG.vector_k, CFG).select("query_id", "key", "score")
    return router.route(asked, near, fused, CFG).select("query_id", "route", "confidence", "threshold")


@query(f"with {DENSE}, b as (select query_id, max(score) as best from dense group by 1) select query_id, best, round(case when best >= {CFG.vector_threshold} then {CFG.vector_threshold} else greatest({CFG.vector_threshold * CFG.adaptive_ratio}, least({CFG.vector_threshold}, best * 0.97)) end, 6)::double as threshold from b")
def adaptive_threshold(spark, d):
    return _dense(spark, d).groupBy("query_id").agg(F.max("score").alias("best")).withColumn("threshold", F.round(router.adaptive_threshold(F.col("best"), CFG), 6))


@query(f"with {DENSE}, b as (select *, max(score) over (partition by query_id) as best from dense) select query_id, key, score from b where best >= {CFG.question_threshold} and score >= round(greatest(best - {CFG.question_margin}, {CFG.question_threshold * CFG.floor_ratio}), 6)")
def multi_answer_margin(spark, d):
    return router.within_margin(_dense(spark, d), CFG).select("query_id", "key", "score")


@query(f"with {DENSE}, r as (select d.query_id, v.label as qa_id, d.score, d.rank from dense d join embeddings v on v.vec_id = d.key) select query_id, qa_id, max(score) as score, arg_min(case when rank % 3 = 1 then 'question' else 'paraphrase' end, rank) as matched_on from r group by all")
def paraphrase_collapse(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("qa_id"))
    rows = _dense(spark, d).join(labels, "key").withColumn("row_kind", F.when(F.col("rank") % 3 == 1, "question").otherwise("paraphrase"))
    return fusion.collapse(rows, "qa_id", "row_kind")


PHRASED = "select query_id || '#' || pos as query_id, text from (select item_id as query_id, 0 as pos, text from benchmark union all select item_id, 1, array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ') from benchmark union all select item_id, 2, array_to_string(list_slice(string_split(text, ' '), 9, 100000000), ' ') from benchmark)"


@query(
    f"""with {bm25_sql(PHRASED, CFG.vector_k)},
r as (select split_part(query_id, '#', 1)::bigint as query_id, key, round(sum(1.0::double / ({CFG.rrf_k} + rank)), 9) as rrf, max(score) as score from sparse group by 1, 2)
select query_id, key, rrf, score, rank::int as rank from (select *, row_number() over (partition by query_id order by rrf desc, score desc, key) as rank from r) where rank <= {CFG.vector_k}"""
)
def rrf_phrasings(spark, d):
    """Each passage searched whole, by its first eight words and by the rest, fused."""
    words = F.split("text", " ")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.array("text", F.array_join(F.slice(words, 1, 8), " "), F.array_join(F.slice(words, 9, 100_000_000), " "))).alias("pos", "text"))
    numbered = asked.withColumn("phrasing", F.concat_ws("#", "query_id", "pos"))
    index = sparse.build(table(spark, d, "documents"), "doc_id", "text", CFG)
    hits = sparse.search(index, numbered, "phrasing", "text", CFG.vector_k, CFG)
    per = hits.select(F.substring_index("query_id", "#", 1).cast("long").alias("query_id"), "key", "rank", "score")
    return fusion.reciprocal_ranks(per, CFG.vector_k, CFG)


@query(
    f"""with t as materialized (select doc_id, list_sort(list_distinct({sql_tokens('text')})) as w from documents),
s as materialized (select doc_id, w, min(doc_id) over (partition by w) as same_as from t),
r as materialized (select doc_id, w, len(w) as n from s where doc_id = same_as and len(w) > 0),
e as materialized (select doc_id, n, unnest(w) as word from r),
p as (select a.doc_id as x, any_value(a.n + b.n) as total, count(*) as i from e a join e b on a.word = b.word and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by a.doc_id, b.doc_id),
c as (select x, count(*) as n from p where 100 * i >= 90 * (total - i) group by x)
select s.doc_id, s.same_as, coalesce(c.n, 0) as n_links from s left join c on c.x = s.same_as"""
)
def near_duplicate_docs(spark, d):
    return similar.near_duplicates(table(spark, d, "documents"), "doc_id", "text", CFG).withColumnRenamed("key", "doc_id")


@query()
def distinct_answers(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    hits = scratch.written(_sparse(spark, d).where("rank <= 12"), "hits")  # twelve for each query, so that texts need no shuffle
    return router.distinct_answers(texts.join(scratch.small(hits), "key"), "key", "text", CFG)


@query(f"select doc_id, source, lang from (select *, row_number() over (partition by array_to_string({sql_tokens('text')}, ' ') order by length(text) desc, doc_id) as n from documents) where n = 1")
def merge_dedupe_longest(spark, d):
    return grounding.merge_longest(table(spark, d, "documents"), "text", "text", ["doc_id"]).select("doc_id", "source", "lang")


@query(
    """with q as (select item_id, ' ' || array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ') || ' ' as n, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) as k from benchmark),
t as (select doc_id, ' ' || array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ') || ' ' as h from documents)
select item_id, doc_id from q join t on contains(h, n) where k >= 3"""
)
def evidence_exact_match(spark, d):
    # a document can hold a passage only if it holds its first three words in sequence: an equi-join finds those
    trigrams = lambda w: F.transform(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 2)), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
    q = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), tx.grounding_tokens(F.col("text")).alias("w")).where(F.size("w") >= CFG.min_evidence_tokens).select("item_id", "quote", F.concat_ws(" ", F.slice("w", 1, 3)).alias("t"))
    docs = scratch.spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("w", tx.grounding_tokens(F.col("text")))
    places = docs.select("doc_id", F.explode(F.array_distinct(trigrams(F.col("w")))).alias("t")).join(q.select("t").distinct(), "t", "left_semi")
    pairs = places.join(q, "t").select("item_id", "quote", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    return pairs.where(grounding.holds(F.col("text"), F.col("quote"))).select("item_id", "doc_id")


@query()
def evidence_fuzzy_match(spark, d):
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("quote"))
    pairs = grounding.candidates(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), quotes, "text", "quote", CFG)
    return grounding.locate(pairs, "text", "quote", cfg=CFG).where("span is not null").select("query_id", "key", F.length("span").alias("span_chars"))


@query()
def chunk_documents(spark, d):
    return chunker.chunk_table(files.documents_as_pages(table(spark, d, "documents")), CFG).select("chunk_id", "doc_id", "ordinal", "parent_id", "chunk_kind", F.length("text").alias("chars"))


@query(
    """with c as (select source as doc_id, (row_number() over (partition by source order by doc_id) - 1)::int as ordinal, doc_id as id, count(*) over (partition by source) as n from documents)
select doc_id, (min(ordinal))::int as ordinal, count(*) as children, arg_min(id, ordinal) as first_id, arg_max(id, ordinal) as last_id from c where n > 1 group by doc_id, ordinal // 3"""
)
def parent_windows(spark, d):
    order = Window.partitionBy("source").orderBy("doc_id")
    rows = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.lit("x").alias("doc_name"), (F.row_number().over(order) - 1).alias("ordinal"), F.col("doc_id").cast("string").alias("text"), F.lit("").alias("section"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    ids = F.split("text", "\n\n")
    return chunker.parents(rows, CFG).select("doc_id", "ordinal", F.size(ids).cast("long").alias("children"), F.element_at(ids, 1).cast("long").alias("first_id"), F.element_at(ids, -1).cast("long").alias("last_id"))


@query("select conv_id, turn, md5(coalesce(lag(text) over w, '')) as prev, md5(coalesce(lead(text) over w, '')) as next from conversations window w as (partition by conv_id order by turn)")
def neighbor_chunks(spark, d):
    return chunker.neighbours(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5(F.coalesce("prev_text", F.lit(""))).alias("prev"), F.md5(F.coalesce("next_text", F.lit(""))).alias("next"))


@query("select source as doc_id, source as doc_name, count(*) as chunk_count, count(distinct l.doc_id) as qa_count from documents d left join labels l using (doc_id) group by source")
def corpus_listing(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("source").alias("doc_id"), F.col("source").alias("doc_name"))
    pairs = table(spark, d, "labels").join(docs, "doc_id").select(F.col("source").alias("doc_id"), F.col("source").alias("doc_name"), F.col("doc_id").alias("qa_id"))
    return bank.listing(chunks, pairs).withColumn("chunk_count", F.col("chunk_count").cast("long"))


TYPE_SQL = "case doc_id % 4 when 0 then 'factual' when 1 then 'multi_hop' when 2 then 'critical' else 'causal' end"


def _bank(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as bank entries: the first line asks, the rest answers."""
    kind = F.get(F.array(*map(F.lit, ("factual", "multi_hop", "critical", "causal"))), (F.col("doc_id") % 4).cast("int"))
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.select(F.col("doc_id").alias("qa_id"), kind.alias("question_type"), F.when(F.col("quality") == 1, "basic").otherwise("advanced").alias("difficulty"), F.col("source").alias("doc_name"), F.col("source").alias("doc_id"), F.lit(1).alias("page_start"), F.substring_index("text", "\n", 1).alias("question"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("answer"), F.array("lang").alias("keywords"))


@query(
    f"""with b as (select doc_id, {TYPE_SQL} as t, case when quality = 1 then 'basic' else 'advanced' end as v from labels join documents using (doc_id)), h as (select *, (t in ('multi_hop', 'critical', 'application'))::int as hard from b)
select case when grouping(t) = 0 then 'type' when grouping(v) = 0 then 'difficulty' else 'total' end as grouping, coalesce(t, v, '') as name, count(*) as n, coalesce(sum(hard), 0)::bigint as hard from h group by grouping sets ((t), (v), ())"""
)
def bank_summary(spark, d):
    return bank.summary(_bank(spark, d))


@query(
    f"""with b as (select doc_id as qa_id, {TYPE_SQL} as t, source, lang, split_part(text, chr(10), 1) as question, substr(text, length(split_part(text, chr(10), 1)) + 2) as answer from labels join documents using (doc_id))
select qa_id, source as doc_name, t as question_type from b where t in ('factual', 'critical') and (contains({sql_fold("question")}, 'th') or contains({sql_fold("answer")}, 'th') or contains(lang, 'th')) order by {sql_fold("source")}, {sql_fold("question")}, qa_id limit 50 offset 10"""
)
def bank_page(spark, d):
    return bank.page(_bank(spark, d).where(bank.matches(types=["factual", "critical"], needle=" Th ")), 10, 50).select("qa_id", "doc_name", "question_type")


@query(f"with v(name) as (values {', '.join(f'({x!r})' for x in DIFFICULTIES)}), c as (select case when quality = 1 then 'basic' else 'advanced' end as name, count(*) as n from labels group by 1) select name, coalesce(n, 0) as n, round(coalesce(n, 0) / greatest(1, sum(n) over ()), 3)::double as share from v left join c using (name)")
def zero_filled_distribution(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "basic").otherwise("advanced").alias("difficulty"))
    return bank.zero_filled(rows, "difficulty", DIFFICULTIES)


def sql_plain(c: str) -> str:
    out = f"translate({c}, '{''.join(k for k in tx.PLAIN_ONE)}{tx.INVISIBLE}', '{''.join(tx.PLAIN_ONE.values()).replace(chr(39), chr(39) * 2)}')"
    for a, b in (*tx.PLAIN_MORE.items(), ("\r\n", "\n"), ("\r", "\n")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


SQL_INNER = SQL_SPACE[1:-1]


@query(
    f"""with l as materialized (select source as doc_id, doc_id as page, list_filter(list_transform(string_split({sql_plain("'Annual report 12' || chr(10) || coalesce(text, '')")}, chr(10)), lambda x: regexp_replace(x, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')), lambda x: x <> '') as l from documents),
k as (select distinct doc_id, page, lower(trim(regexp_replace(regexp_replace(regexp_replace(line, '\\p{{Nd}}+', '', 'g'), '[^\\p{{L}}\\p{{N}}_{SQL_INNER}]+', ' ', 'g'), '{SQL_SPACE}+', ' ', 'g'))) as key
  from (select doc_id, page, unnest(list_concat(l[1:{pages.EDGE}], l[greatest(1, len(l) - {pages.EDGE} + 1):])) as line from l)),
o as (select doc_id, count(distinct page) as pages_of from l group by doc_id)
select k.doc_id, key, count(distinct page) as n_pages from k join o on o.doc_id is not distinct from k.doc_id where length(key) >= 3 and pages_of >= {pages.LEAST_PAGES} group by k.doc_id, key, pages_of having count(distinct page) >= greatest(2, ceil(round({pages.REPEAT} * pages_of, 9)))"""
)
def running_lines(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), F.concat(F.lit("Annual report 12\n"), tx.text_or_empty(F.col("text"))).alias("text"))
    return pages.running_lines(scratch.spread(docs))


@query(
    """with g as (select l.doc_id, l.quality, d.n_chars > 1500 as answered, case when d.n_chars > 1500 then 'question_bank' else 'refused' end as route from labels l join documents d using (doc_id))
select count(*) as total, round(count(*) filter (quality = 0 or route = 'question_bank') / count(*), 3)::double as route_accuracy, round(count(*) filter ((quality = 1) = answered) / count(*), 3)::double as answered_accuracy, round(count(*) filter (not answered) / count(*), 3)::double as refuse_rate from g"""
)
def eval_rollup(spark, d):
    golden = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, F.array(F.lit("question_bank"))).alias("expect_route"), (F.col("quality") == 1).alias("expect_answered"), F.lit(None).cast("array<string>").alias("must_contain"))
    answered = F.col("n_chars") > 1500
    outcomes = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.when(answered, "question_bank").otherwise("refused").alias("route"), answered.alias("answered"), F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("groundedness"), F.lit("").alias("answer"))
    return records.evaluate(golden, outcomes).select("total", "route_accuracy", "answered_accuracy", "refuse_rate")


@query(
    """with r as (select * from events order by ts desc, event_id desc limit 500)
select count(*) as searches, count(*) filter (event_type <> 'error') as answered, count(*) filter (event_type = 'error') as refused, round(count(*) filter (event_type = 'error') / count(*), 4)::double as refuse_rate, round(avg(value) filter (value <> 0), 2)::double as avg_latency from r"""
)
def metrics_summary(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", F.lit("search").alias("kind"), (F.col("event_type") != "error").alias("answered"), F.col("value").alias("elapsed"))
    return records.metrics_summary(events, "ts", "event_id")


@query("select doc_id, 'new' as state from labels union all select doc_id, 'old' from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def upsert_antijoin(spark, d):
    new = table(spark, d, "labels").select("doc_id").withColumn("state", F.lit("new"))
    old = table(spark, d, "documents").select("doc_id").withColumn("state", F.lit("old"))
    return without(old, new, "doc_id").unionByName(new)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def ingest_new_only(spark, d):
    return new_only(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"))


@query("select doc_id, source from documents where source is distinct from 'src0'")
def delete_document(spark, d):
    return table(spark, d, "documents").where(~F.col("source").eqNullSafe(F.lit("src0"))).select("doc_id", "source")


@query(
    f"""with t as (select conv_id, turn, {sql_one_space("text")} as c from conversations), h as (select *, substr(c, 1, 120) as head from t),
s as (select *, length(head) - length(regexp_extract(head, '[^ ]*$')) - 1 as sp from h)
select conv_id, turn, case when length(c) <= 120 then c else regexp_replace(case when sp > 60 then substr(head, 1, sp) else head end, '[ ,;:.]+$', '') || '…' end as quote from s"""
)
def excerpt(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.excerpt(F.col("text"), 120).alias("quote"))


@query("select event_id, round(case when event_type = 'error' then 1.0 else greatest(0, least(1, 1 - (0.6 * (event_id % 101) / 100.0::double + 0.4 * coalesce(case when event_id % 5 = 0 then null else (event_id % 7) / 6.0::double end, 1.0)))) end, 6)::double as uncertainty from events")
def uncertainty_expr(spark, d):
    g = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 7) / 6.0)
    return table(spark, d, "events").select("event_id", F.round(tx.uncertainty((F.col("event_id") % 101) / 100.0, g, F.col("event_type") != "error"), 6).alias("uncertainty"))


@query(
    f"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || ' [1][2] and then and [2].' || turn, '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]+([.,;:!?)\\]])', '\\1', 'g'), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') as answer, '3,1' as cited from conversations"""
)
def citation_remap(spark, d):
    # no turn of the table holds a bracket; markers of all kinds are added
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(tx.text_or_empty(F.col("text")), F.lit(" [3, 1] and [9] then [1-3] and [1]."), F.col("turn")).alias("answer"), F.lit(4).alias("n"))
    return answers.remap_citations(rows, "answer", "n").select("conv_id", "turn", "answer", F.concat_ws(",", "cited").alias("cited"))


@query("select conv_id as query_id, avg((turn % 3 <> 0)::int)::double as groundedness, count(*) filter (turn % 3 = 0) as n_unsupported from conversations where trim(text) <> '' group by conv_id")
def groundedness_score(spark, d):
    claims = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("text").alias("claim"), F.when(F.col("turn") % 3 == 0, "unsupported").otherwise(" supported").alias("verdict"))
    return answers.groundedness(claims).select("query_id", "groundedness", F.size("unsupported").cast("long").alias("n_unsupported"))


@query(f"select doc_id, regexp_replace({sql_one_space('text')}, '[.:;,]+$', '') || '?' as question from documents where regexp_replace({sql_one_space('text')}, '[.:;,]+$', '') <> ''")
def clean_questions(spark, d):
    return scratch.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tx.clean_question(F.col("text")).alias("question")).where("question <> ''")


@query()
def html_pages_extract(spark, d):
    return files.html_pages(table(spark, d, "pages")).select("doc_id", "doc_name", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def daily_event_rollup(spark, d):
    return rollup.daily(table(spark, d, "events"))


@query("select conv_id, count(*) as n, string_agg(role, ',' order by turn) as roles from conversations group by conv_id")
def conversation_roles(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(turns, lambda t: t["role"]), ",").alias("roles"))


SQL_STRIP = f"^{SQL_SPACE}+|{SQL_SPACE}+$"


@query(
    f"""with t as (select source as doc_id, doc_id as page, length({sql_one_space("text")})::bigint as chars, regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g') as letters from documents),
l as (select *, case when chars < {CFG.ocr_min_chars} then 'empty' when length(letters) > 0 and (length(letters) - length(regexp_replace(letters, '{tx.RTL}', '', 'g')))::double / length(letters) > {CFG.ocr_rtl_ratio} then 'unreliable' else 'ok' end as layer from t)
select doc_id, count(*) as pages, count(*) filter (layer = 'ok') as pages_ok, count(*) filter (layer = 'empty') as pages_empty, count(*) filter (layer = 'unreliable') as pages_unreliable, count(*) filter (layer <> 'ok') as pages_to_ocr,
coalesce(string_agg(page::varchar, ',' order by page) filter (layer <> 'ok'), '') as degraded_pages, sum(chars)::bigint as total_chars from l group by doc_id"""
)
def page_report_summary(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text")
    return pages.report_summary(pages.report(rows, CFG)).withColumn("degraded_pages", F.concat_ws(",", "degraded_pages")).withColumn("total_chars", F.col("total_chars").cast("long"))


@query("select count(*) as pairs, count(distinct doc_id) as chunks_covered, 1.0::double as evidence_per_pair, round(avg(length(substr(text, length(split_part(text, chr(10), 1)) + 2))), 1)::double as answer_chars from labels join documents using (doc_id)")
def extraction_totals(spark, d):
    rows = _bank(spark, d).withColumn("chunk_id", F.col("qa_id")).withColumn("evidence", F.array("question"))
    return bank.extraction_report(rows)["totals"]


@query("select event_type as query, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last from events group by 1 order by max(ts) desc, 1 limit 8")
def search_history(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("query"), "ts")
    return records.history(events).select("query", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("select event_type as kind, count(*) as n, count(*) filter (value > 50) as answered from events group by 1")
def metrics_totals(spark, d):
    return records.totals(table(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("value") > 50).alias("answered")))


@query(
    """with p as (select conv_id, turn, text as first, lead(text) over (partition by conv_id order by turn) as second from conversations),
q as (select *, row_number() over (partition by conv_id order by turn) - 1 as k, count(*) over (partition by conv_id) as n from p where second is not null)
select conv_id, turn, md5(first) as first, md5(second) as second from q where n <= 3 or k = 0 or floor(k * 3 / n) <> floor((k - 1) * 3 / n)"""
)
def adjacent_pairs(spark, d):
    return chunker.adjacent_pairs(table(spark, d, "conversations"), "conv_id", "turn", "text", 3).select("conv_id", "turn", F.md5("first").alias("first"), F.md5("second").alias("second"))


@query("select count(*) filter (lang <> 'fr') as documents, count(*) filter (lang = 'fr') as failed, count(*)::bigint as pages, sum(n_chars)::bigint as chunks, sum(length(source))::bigint as questions, sum(n_chars / 4.0)::double as elapsed, sum(case when lang = 'de' then 2 else 0 end)::bigint as ocr_pages from documents")
def ingest_totals(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit(1).alias("pages"), F.when(F.col("lang") == "de", F.array(F.lit(1), F.lit(2))).alias("ocr_pages"), F.col("n_chars").alias("chunks"), F.length("source").alias("questions"), (F.col("n_chars") / 4.0).alias("elapsed"), F.when(F.col("lang") == "fr", "broken").alias("error"))
    return records.batch_totals(rows)


@query(
    """with r as (select source, count(*) filter (lang = 'fr') as n_fr, count(*) filter (lang = 'en') as n_en from documents group by source),
p as (select count(*) as kept from documents where lang = 'en')
select count(*) as chunks, count(*) filter (n_fr > 0) as chunks_failed, count(*) filter (n_fr = 0 and n_en = 0) as chunks_empty,
array_to_string(list_slice(coalesce(list(source || ': failed' order by source) filter (n_fr > 0), []), 1, 8), '|') as failure_samples, any_value(kept) as pairs_kept, round(any_value(kept) / count(*), 2)::double as questions_per_chunk from r cross join p"""
)
def extraction_coverage(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("chunk_id"), F.when(F.col("lang") == "en", F.col("text")).alias("question"), F.when(F.col("lang") == "fr", "failed").alias("error"))
    out = records.coverage(docs.select("chunk_id"), docs, docs.where("question is not null"))
    return out.withColumn("failure_samples", F.concat_ws("|", "failure_samples"))


@query("select doc_id, case when doc_id % 3 = doc_id % 5 then 'p. ' || (doc_id % 3) else 'pp. ' || (doc_id % 3) || '-' || (doc_id % 5) end as label, source || ', ' || case when doc_id % 3 = doc_id % 5 then 'p. ' || (doc_id % 3) else 'pp. ' || (doc_id % 3) || '-' || (doc_id % 5) end as citation from documents")
def page_labels(spark, d):
    label = tx.page_label(F.col("doc_id") % 3, F.col("doc_id") % 5)
    return table(spark, d, "documents").select("doc_id", label.alias("label"), tx.citation(F.col("source"), label).alias("citation"))


@query(
    f"""with r as (select conv_id, turn, case turn % 4 when 0 then 'INSUFFICIENT_CONTEXT' when 1 then coalesce(text, '') || chr(10) || 'insufficient_context: rest' when 2 then '**Insufficient_Context** ' || substr(coalesce(text, ''), 1, 20) else coalesce(text, '') end as t from conversations),
x as (select *, regexp_replace(regexp_replace(t, '(?i)INSUFFICIENT_CONTEXT', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as rest from r)
select conv_id, turn, regexp_replace(t, '{SQL_STRIP}', '', 'g') = '' or (contains(upper(t), 'INSUFFICIENT_CONTEXT') and length(rest) <= 60) as insufficient,
md5(regexp_replace(regexp_replace(regexp_replace(t, '(?im)^.*INSUFFICIENT_CONTEXT.*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '{SQL_STRIP}', '', 'g')) as rest from x"""
)
def refusal_sentinel(spark, d):
    text, case = tx.text_or_empty(F.col("text")), F.col("turn") % 4
    reply = F.when(case == 0, "INSUFFICIENT_CONTEXT").when(case == 1, F.concat(text, F.lit("\ninsufficient_context: rest"))).when(case == 2, F.concat(F.lit("**Insufficient_Context** "), F.substring(text, 1, 20))).otherwise(text)
    return table(spark, d, "conversations").select("conv_id", "turn", answers.is_insufficient(reply).alias("insufficient"), F.md5(answers.strip_sentinel(reply)).alias("rest"))


@query("select event_id, event_type = 'click' and value >= 85 as skipped from events")
def audit_skips(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "question_bank").otherwise("hybrid").alias("route"), (F.col("value") / 100).alias("confidence"))
    return rows.select("event_id", answers.may_skip_audit(CFG).alias("skipped"))


SQL_WORDS = "[" + ", ".join(f"'{x}'" for x in QUESTION_TYPES) + "]"


@query(
    f"""with l as (select conv_id, turn, case turn % 5 when 0 then 'Multi-Hop reasoning' when 1 then ' FACTUAL ' when 2 then 'quant' when 3 then role else null end as label from conversations),
s as (select *, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(label, ''), '{SQL_STRIP}', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from l),
c as (select *, list_filter({SQL_WORDS}, lambda v: starts_with(v, slug) or starts_with(slug, v)) as near from s)
select conv_id, turn, case when list_contains({SQL_WORDS}, slug) then slug when slug <> '' and len(near) > 0 then near[1] else 'conceptual' end as kind from c"""
)
def vocabulary_labels(spark, d):
    k = F.col("turn") % 5
    label = F.when(k == 0, "Multi-Hop reasoning").when(k == 1, " FACTUAL ").when(k == 2, "quant").when(k == 3, F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.coerce_vocabulary(label, QUESTION_TYPES, "conceptual").alias("kind"))


@query(
    f"""with r as (select conv_id, turn, regexp_replace(case turn % 3 when 0 then 'According to the passage, as stated in the text, ' when 1 then ' The document explains that ' else '' end || coalesce(text, ''), '{SQL_STRIP}', '', 'g') as t from conversations),
c as (select *, regexp_replace(regexp_replace(t, '{tx.HEDGE}', ''), '{tx.HEDGE}', '') as o from r)
select conv_id, turn, md5(upper(substr(o, 1, 1)) || substr(o, 2)) as answer from c"""
)
def clean_answers(spark, d):
    k = F.col("turn") % 3
    opening = F.when(k == 0, "According to the passage, as stated in the text, ").when(k == 1, " The document explains that ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.clean_answer(F.concat(opening, tx.text_or_empty(F.col("text"))))).alias("answer"))


@query(
    f"""with l as (select doc_id, case doc_id % 6 when 0 then 'Page ' || doc_id when 1 then '- ' || (doc_id % 90) || ' -' when 2 then 'xiv' when 3 then (doc_id % 90) || ' of 340' when 4 then 'Chapter ' || doc_id || ' - The  END' else source end as line from documents)
select doc_id, regexp_matches(line, '{tx.FOLIO_LINES[0]}') or regexp_matches(line, '{tx.FOLIO_LINES[1]}') as folio, lower(trim(regexp_replace(regexp_replace(regexp_replace(line, '\\p{{Nd}}+', '', 'g'), '[^\\p{{L}}\\p{{N}}_{SQL_INNER}]+', ' ', 'g'), '{SQL_SPACE}+', ' ', 'g'))) as key from l"""
)
def line_keys(spark, d):
    k, n = F.col("doc_id") % 6, (F.col("doc_id") % 90).cast("string")
    line = F.when(k == 0, F.concat(F.lit("Page "), "doc_id")).when(k == 1, F.concat(F.lit("- "), n, F.lit(" -"))).when(k == 2, "xiv").when(k == 3, F.concat(n, F.lit(" of 340"))).when(k == 4, F.concat(F.lit("Chapter "), "doc_id", F.lit(" - The  END"))).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", tx.is_folio(line).alias("folio"), tx.repeat_key(line).alias("key"))


@query("select doc_id, md5(" + sql_plain("coalesce(text, chr(39)) || ' “q” — it’s… ﬁne' || chr(13) || chr(10) || 'x'") + ") as digest from documents")
def plain_texts(spark, d):
    text = F.concat(F.coalesce("text", F.lit("'")), F.lit(" “q” — it’s… ﬁne\r\nx"))
    return table(spark, d, "documents").select("doc_id", F.md5(tx.plain_unicode(text)).alias("digest"))


@query(
    f"""with w as (select conv_id, turn, list_distinct({sql_tokens("text")}) as w from conversations),
t as (select conv_id, turn, w, lag(w) over (partition by conv_id order by turn) as p from w),
j as (select conv_id, turn, len(list_intersect(w, p)) as i, len(w) + len(p) - len(list_intersect(w, p)) as u from t where p is not null)
select conv_id, turn, round(case when u = 0 then 1.0 else i / u end, 6)::double as jaccard from j"""
)
def turn_similarity(spark, d):
    words = F.array_distinct(tx.tokens(F.col("text")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", words.alias("w")).withColumn("p", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where("p is not null").select("conv_id", "turn", F.round(tx.jaccard(F.col("w"), F.col("p")), 6).alias("jaccard"))


@query(
    f"""with {DENSE}, h as (select query_id, key, rank from dense where rank <= {CFG.vector_k})
select query_id, key, (case when query_id % 2 = 0 then 4 - rank else rank end)::int as place from h where query_id % 2 = 1 or rank <= 3"""
)
def reranked_hits(spark, d):
    """Even queries are given their first three hits in reverse, odd ones an order that can't be used."""
    hits = scratch.written(_dense(spark, d).where(F.col("rank") <= CFG.vector_k).select("query_id", "key", F.col("rank").alias("place")), "hits")
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("p"), "key"))), lambda x: x["key"])
    orders = hits.where("place <= 3").groupBy("query_id").agg(listed.alias("order")).withColumn("order", F.when(F.col("query_id") % 2 == 0, F.col("order")).otherwise(F.array(F.lit(-1).cast("long"))))
    return router.reranked(hits, orders).select("query_id", "key", F.col("place").cast("int").alias("place"))


@query(
    """with old as (select 'r' || doc_id as review_id, 'old ' || lang as question, source as answer, 'a' as created_at, case when doc_id % 2 = 0 then 'b' else 'a' end as updated_at, 'refused' as route from documents),
new as (select 'r' || item_id as review_id, 'new' as question, '' as answer, 'c' as created_at, 'c' as updated_at, 'hybrid' as route from benchmark)
select coalesce(o.review_id, n.review_id) as review_id, case when n.review_id is null or o.updated_at <> o.created_at then o.question else n.question end as question, case when n.review_id is null or (o.updated_at <> o.created_at and o.answer <> '') then o.answer else n.answer end as answer,
coalesce(o.created_at, n.created_at) as created_at, coalesce(n.updated_at, o.updated_at) as updated_at, coalesce(n.route, o.route) as route from old o full join new n on o.review_id = n.review_id"""
)
def reviews_merged(spark, d):
    when = F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a")
    old = table(spark, d, "documents").select(F.concat(F.lit("r"), "doc_id").alias("review_id"), F.concat(F.lit("old "), "lang").alias("question"), F.col("source").alias("answer"), F.lit("a").alias("created_at"), when.alias("updated_at"), F.lit("refused").alias("route"))
    new = table(spark, d, "benchmark").select(F.concat(F.lit("r"), "item_id").alias("review_id"), F.lit("new").alias("question"), F.lit("").alias("answer"), F.lit("c").alias("created_at"), F.lit("c").alias("updated_at"), F.lit("hybrid").alias("route"))
    return records.merge_reviews(old, new)


@query("select d.doc_id as review_id, case when l.doc_id is null then 'manual' else d.doc_id::varchar end as doc_id, case when l.doc_id is null then 'Manual entries' else source end as doc_name, case when l.doc_id is null then 0 else 7 end as page_start from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id")
def orphan_reviews(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("doc_name"), F.lit(7).alias("page_start"))
    known = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return records.with_provenance(rows, known)
