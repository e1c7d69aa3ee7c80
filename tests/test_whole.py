"""Queries of the catalogue over small tables, where a cut of their input would show."""

import random

from pyspark.sql import functions as F

from lodestone import registry
from lodestone.operators import grounding, similar


def test_fuzzy_evidence_equals_brute_force(spark, tmp_path):
    r = random.Random(4)
    common, rare = [f"w{k}" for k in range(30)], [f"r{k}" for k in range(400)]
    some = lambda n, of: [r.choice(of) for _ in range(n)]
    quotes = [(k, " ".join(some(12, rare) + some(4, common))) for k in range(4)] + [(10, "Straße ſo groß wie ein Haus"), (11, "two words"), (12, " ".join(some(6, common))), (13, "w1 w1 w1"), (14, None), (None, " ".join(some(9, rare)))]
    docs = []
    for k in range(60):
        text = some(r.randrange(0, 80), common)
        q = quotes[r.randrange(len(quotes))][1] or ""
        passage = q.split()
        for _ in range(r.randrange(0, 5)):
            if passage:
                passage[r.randrange(len(passage))] = r.choice(common)
        at = r.randrange(len(text) + 1)
        docs.append((None if k % 9 == 8 else k, " ".join(text[:at] + passage + text[at:])))
    docs += [(100 + k, f"{k} " + quotes[0][1].upper()) for k in range(8)] + [(200, "STRASSE so GROSS WIE EIN HAUS"), (201, None), (202, ""), (100, f"0 {quotes[0][1].upper()}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(i, d, len(s)) for i, q in quotes for d, t in docs if (s := grounding.find_span(t, q)) is not None]
    got = [tuple(x) for x in registry.queries()["evidence_fuzzy_match"](spark, str(tmp_path)).select("query_id", "key", "span_chars").collect()]
    assert sum(i == 0 for i, _, _ in want) > 8 and (10, 200) in {x[:2] for x in want} and any(d is None for _, d, _ in want)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_citations_after_a_long_text_are_remapped(spark, tmp_path):
    rows = [(1, 0, "user", "word " * 40 + "as shown in [4] and [7]."), (1, 1, "user", "short")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.turn: x for x in registry.queries()["citation_remap"](spark, str(tmp_path)).collect()}
    assert got[0].answer.startswith("word " * 40 + "as shown in [1]") and "[7]" not in got[0].answer and "4" in got[0].cited.split(",") and "4" not in got[1].cited.split(",")


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    """Groups of near copies of all sizes, over more blocks than one, and what reaches the comparison."""
    monkeypatch.setattr(similar, "BLOCK", 16)
    monkeypatch.setattr(similar, "FREQUENT", 50)
    r = random.Random(5)
    docs = [(None, "w1 w2"), (900, ""), (901, None), (902, "W1 w2"), (903, "w1")]
    for group in range(6):
        words = [f"w{r.randrange(60)}" if r.random() < 0.3 else f"g{group}x{k}" for k in range((8, 25, 60, 150, 400, 900)[group])]
        for k in range(40):
            some = list(words)
            for _ in range(r.randrange(0, max(2, len(some) // 9))):
                some[r.randrange(len(some))] = f"n{r.randrange(3000)}"
            docs.append((group * 100 + k, " ".join(some)))
    sets = {d: frozenset((t or "").lower().split()) for d, t in docs if d is not None}
    names = {s: min(d for d, x in sets.items() if x == s) for s in set(sets.values())}
    near = {s: sum(s != t and 10 * len(s & t) >= 9 * len(s | t) for t in names if s and t) for s in names}
    got = {x.key: (x.same_as, x.n_links) for x in similar.near_duplicates(spark.createDataFrame(docs, "k long, t string"), "k", "t").collect()}
    assert {d: got[d] for d in sets} == {d: (names[s], near[s]) for d, s in sets.items()} and got[None] == got[902] and sum(near.values()) > 300


def test_unrelated_sets_of_one_passage_are_not_compared(spark, monkeypatch):
    """Texts that share a rare passage share all first words; whole sets must not go out for them."""
    passage = " ".join(f"rare{k}" for k in range(30))
    r = random.Random(6)
    docs = [(k, passage + " " + " ".join(f"c{j}" for j in r.sample(range(600), 200))) for k in range(60)]
    compared = []
    monkeypatch.setattr(similar, "_compared", lambda percent: compared.append(percent) or (lambda pairs, sets: pairs.select(["a", "b"])))
    out = similar.near_duplicates(spark.createDataFrame(docs, "k long, t string"), "k", "t")
    assert compared == [90] and out.agg(F.sum("n_links")).first()[0] == 0


def test_texts_are_cut_in_pieces_of_bounded_size():
    """Python holds the words of one piece at a time, whatever the rows of a batch."""
    import pyarrow as pa

    texts = ["word " * (k % 7 * 20_000) for k in range(60)] + [None, "", "x" * (3 * grounding.PIECE), "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)] * 2, ["0", "1"])
    pieces = [p.column(0).to_pylist() for p in grounding._pieces(batch)]
    assert [t for p in pieces for t in p] == texts and len(pieces) > 15
    assert all(len(p) == 1 or 2 * sum(len(t or "") for t in p) <= grounding.PIECE for p in pieces)
    assert list(grounding._pieces(batch.slice(0, 0))) == []


def test_distinct_answers_deal_no_texts(spark, sf):
    """The few hits go to the texts, not the texts to the hits."""
    plan = registry.queries()["distinct_answers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
