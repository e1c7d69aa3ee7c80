"""The facade: model-backed steps and their failures, answers and their records, reviews, snapshots."""

import pytest
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.operators import answers, chunker, pages, router
from lodestone.plans.engine import Engine, Steps
from lodestone.sources import files, store

ROWS = "doc_id string, doc_name string, page_number int, text string"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}/s", EngineConfig(hybrid=False))
    e.ingest(spark.createDataFrame([
        ("d1", "bridge", 1, "The harbour bridge was opened in nineteen thirty two by the premier. Ferries crossed the harbour before the bridge was built. " * 3),
        ("d2", "cooking", 1, "Bread dough rises because yeast makes carbon dioxide in a warm kitchen. Salt slows the yeast down a little in every dough."),
    ], ROWS))
    return e


def asked(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts, 1)], "query_id string, query string")


def test_phrasings(spark, engine):
    split = lambda q: q.select("query_id", F.posexplode(F.split("query", " and ")).alias("pos", "text")).where("query_id <> '3'")
    expand = lambda p: p.select("query_id", "pos", F.posexplode(F.array(F.upper("text"), F.concat("text", F.lit(" x")), F.lit(" "), F.concat("text", F.lit(" y")), F.concat("text", F.lit(" z")), F.concat("text", F.lit(" w")))).alias("n", "text"))
    q = asked(spark, "one and two", "plain", "a; b")
    e = Engine(spark, engine.store.root, steps=Steps(split=split, expand=expand))
    got = {(r.query_id, r.pos, r.n): r.text for r in e.phrasings(q).collect()}
    assert got[("1", 0, 0)] == "one" and got[("1", 1, 0)] == "two" and got[("2", 0, 0)] == "plain" and got[("3", 0, 0)] == "a; b"
    assert [got[("2", 0, n)] for n in range(4)] == ["plain", "plain x", "plain y", "plain z"] and ("2", 0, 4) not in got
    plain = {(r.query_id, r.text) for r in engine.phrasings(q).collect()}
    assert plain == {("1", "one and two"), ("2", "plain"), ("3", "a; b")}


def test_parts_find_what_the_whole_does_not(spark, engine):
    split = lambda q: q.select("query_id", F.posexplode(F.split("query", " and ")).alias("pos", "text"))
    e = Engine(spark, engine.store.root, steps=Steps(split=split))
    q = asked(spark, "Who opened the harbour bridge and what slows the yeast down in a dough")
    assert {r.key for r in e.search_phrasings(q).collect()} >= {r.key for r in engine.search_phrasings(q).collect()}
    assert [r.place for r in e.search_phrasings(q).orderBy("place").collect()] == [1, 2]


def test_gate_and_rerank(spark, engine):
    q = asked(spark, "Why does bread dough rise because yeast makes carbon dioxide?")
    question = "What is said about Bread dough rises because yeast makes carbon dioxide"
    exact = asked(spark, question + "?")
    assert engine.route(exact).first().route == "question_bank"
    none = Engine(spark, engine.store.root, engine.cfg, steps=Steps(gate=lambda c: c.groupBy("query_id").agg(F.array().cast("array<string>").alias("keep"), F.lit(0.1).alias("gate_confidence"))))
    assert none.route(exact).first().route != "question_bank"
    failed = Engine(spark, engine.store.root, engine.cfg, steps=Steps(gate=lambda c: c.where("false").select("query_id", F.array("key").alias("keep"), F.lit(0.1).alias("gate_confidence"))))
    assert failed.route(exact).first().route == "question_bank"
    last = lambda h, _: h.groupBy("query_id").agg(F.array(F.max_by("key", "place")).alias("order"))
    hits = engine.search_phrasings(q).orderBy("place").collect()
    one = Engine(spark, engine.store.root, steps=Steps(rerank=last)).search_phrasings(q).collect()
    assert [r.key for r in one] == [hits[-1].key]
    odd = Engine(spark, engine.store.root, steps=Steps(rerank=lambda h, _: h.select("query_id", F.array(F.lit("nothing")).alias("order")).distinct())).search_phrasings(q)
    assert odd.count() == len(hits)


def test_answers_carry_records_and_audits_fail_closed(spark, engine):
    q = asked(spark, "What is said about Bread dough rises because yeast makes carbon dioxide in?", "zzz qqq")
    e = Engine(spark, engine.store.root, EngineConfig(skip_audit=False))
    got = {r.query_id: r for r in e.ask(q).collect()}
    good = got["1"]
    assert good.answered and good.citations[0]["index"] == 1 and good.citations[0].doc_name == "cooking" and good.citations[0].quote and good.groundedness == 1.0
    assert not got["2"].answered and got["2"].citations is None and any("Refused: route" in n for n in got["2"].notes)
    silent = {r.query_id: r for r in e.ask(q, audit=lambda a, s: a.where("false").select("query_id", F.lit("").alias("claim"), F.lit("").alias("verdict"))).collect()}
    assert silent["1"].refusal_reason == "audit failed" and any("withheld" in n for n in silent["1"].notes)
    claimless = {r.query_id: r for r in e.ask(q, audit=lambda a, s: a.select("query_id", F.lit(" ").alias("claim"), F.lit("").alias("verdict"))).collect()}
    assert claimless["1"].answered and claimless["1"].groundedness == 1.0
    bad = {r.query_id: r for r in e.ask(q, audit=lambda a, s: a.select("query_id", F.lit("made up").alias("claim"), F.lit("unsupported").alias("verdict"))).collect()}
    assert bad["1"].refusal_reason == "not grounded" and "Unsupported claim: made up" in bad["1"].notes
    skipped = {r.query_id: r for r in engine.ask(q, audit=lambda a, s: a.where("false").select("query_id", F.lit("").alias("claim"), F.lit("").alias("verdict"))).collect()}
    assert skipped["1"].answered == (skipped["1"].route == "question_bank" and skipped["1"].confidence >= 0.85)


def test_a_search_without_an_embedder_goes_by_words(spark, tmp_path):
    def down(texts):
        raise OSError("embedder is down")

    rows = [(f"d{k}", "n", 1, f"Words of document {w} that are long enough to be a chunk of their own.") for k, w in enumerate(("yeast", "harbour", "bridge", "kitchen"))]
    Engine(spark, f"file://{tmp_path}/s").ingest(spark.createDataFrame(rows, ROWS))
    e = Engine(spark, f"file://{tmp_path}/s", embedder=down)
    first = e.search_chunks(asked(spark, "the yeast")).first()
    assert first.score == 1.0 and "yeast" in first.text
    with pytest.raises(Exception, match="embedder is down"):
        e.ingest(spark.createDataFrame([("d9", "new", 1, "A new document of some length that is to be indexed now.")], ROWS))
    assert "d9" not in {r.doc_id for r in e.documents().collect()}


def test_reviews_and_manual_entries(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    e.ingest(spark.createDataFrame([("d", "n", 1, "Bread dough rises because yeast makes carbon dioxide in a warm kitchen. Salt slows the yeast down.")], ROWS))
    q = asked(spark, "Why does dough rise?", " ")
    e.flag(e.ask(q).join(q, "query_id"))
    first = e.reviews().collect()
    assert [r.query for r in first] == ["Why does dough rise?"]
    e.update_review(spark.createDataFrame([(first[0].review_id, "Edited answer of some length")], "review_id string, answer string"))
    e.flag(e.ask(q).join(q, "query_id"))
    assert [r.answer for r in e.reviews().collect()] == ["Edited answer of some length"]
    before = e.pairs().count()
    e.approve_reviews()
    assert e.reviews().count() == 0 and e.pairs().where("answer = 'Edited answer of some length'").count() == 1 and e.pairs().count() in (before, before + 1)
    e.upsert_qa_pair(spark.createDataFrame([("Q?", "An answer")], "question string, answer string"))
    row = e.pairs().where("question = 'Q?'").first()
    assert (row.doc_id, row.question_type, row.difficulty, row.evidence, row.page_start) == ("manual", "factual", "basic", [], 0)
    e.delete_qa_pair(row.qa_id)
    assert e.pairs().where("question = 'Q?'").count() == 0
    e.export(f"file://{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == e.pairs().count()
    events = spark.createDataFrame([(1.0, "search", True, 0.5)], "ts double, kind string, answered boolean, elapsed double")
    e.record(events, f"file://{tmp_path}/metrics")
    e.record(events, f"file://{tmp_path}/metrics")
    assert files.metrics_or_empty(spark, f"{tmp_path}/metrics").count() == 2 and files.metrics_or_empty(spark, f"{tmp_path}/none").count() == 0
    e.reset()
    assert e.chunks().count() == 0


def test_golden_sets_and_baseline(spark, engine, tmp_path):
    (tmp_path / "g.json").write_text('[{"id": "1", "query": "What is said about Bread dough rises because yeast makes carbon dioxide in?", "expect_route": "question_bank", "expect_answered": true, "must_contain": ["YEAST"]}, {"id": "2", "query": "zzz", "expect_route": ["refused"], "expect_answered": false}]')
    golden = files.golden_questions(spark, str(tmp_path / "g.json"))
    assert {r.query_id: r.expect_route for r in golden.collect()} == {"1": ["question_bank"], "2": ["refused"]}
    row = engine.evaluate(golden).first()
    assert row.total == 2 and row.answered_accuracy == 1.0 and row.contain_accuracy == 1.0
    assert {r.metric for r in engine.compare(golden).collect()} == {"route_accuracy", "refuse_rate", "avg_confidence"}


def test_a_crash_or_another_writer_changes_nothing_half(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    t = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    s.upsert_all({"a": (t((1, "x")), "k"), "b": (t((1, "x")), "k")})
    base, tables = s.snapshot()
    half = s.write("a", t((9, "half")))  # a writer that stops before its commit
    assert s.snapshot() == (base, tables) and s.read("a").first().k == 1
    s.upsert("b", t((2, "y")), "k")
    with pytest.raises(store.Conflict):
        s.commit(base, tables | {"a": half})
    assert {r.k for r in s.read("b").collect()} == {1, 2} and s.read("a").first().k == 1
    other = store.Store(spark, s.root)
    meanwhile = iter([lambda: other.upsert("a", t((5, "other")), "k")])

    def make(tables):
        for f in meanwhile:
            f()
        return {"a": store.without(tables["a"], t((6, "own")), "k").unionByName(t((6, "own")))}

    s.change(make)
    assert {r.k for r in s.read("a").collect()} == {1, 5, 6}
    assert s.vacuum("a") >= 2 and {r.k for r in s.read("a").collect()} == {1, 5, 6} and {r.k for r in s.read("b").collect()} == {1, 2}


def test_files_that_fail_are_reported(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one two")
    (tmp_path / "b.pdf").write_bytes(b"%PDF broken")
    (tmp_path / "c.pdf").write_bytes(b"not one")
    good, bad = files.pdf_files(spark, str(tmp_path))
    assert [r.error for r in bad.collect()] == ["not a PDF file"]

    def reader(body):
        if b"broken" in body:
            raise ValueError("cannot read")
        return body.decode().split()[1:]

    got, errors = files.pdf_pages(good, reader)
    assert {(r.doc_name, r.page_number, r.text) for r in got.collect()} == {("a.pdf", 1, "one"), ("a.pdf", 2, "two")}
    assert [(r.doc_name, r.error) for r in errors.collect()] == [("b.pdf", "ValueError: cannot read")]




def test_html_references(spark):
    df = spark.createDataFrame([(1, None, "<p>caf&eacute; &#8364;5 &hellip; a &lt; b</p><p>x &amp;amp; y</p>"), (2, "u", None)], "page_id int, url string, html string")
    assert {r.doc_id: r.text for r in files.html_pages(df).collect()} == {"1": "café €5 … a < b\nx &amp; y", "2": ""}


def test_sentences_headings_and_lines():
    assert chunker.sentences('He said "Nope." Then (e.g. Smith et al. 1999) J. Doe left... "Yes!" 3.14 is pi? ok no. cut') == ['He said "Nope."', "Then (e.g. Smith et al. 1999) J. Doe left...", '"Yes!"', "3.14 is pi? ok no. cut"]
    assert chunker.sentences("  ") == [] and chunker.sentences("One") == ["One"]
    yes = ["2.1 Data and methods used", "3. Results of it", "IV. Findings", "RESULTS", "Model Architecture and Training", "Introduction"]
    no = ["II Findings of the old", "it is so", "A b c.", "x" * 130, "", "12", "Two\nLines", "3) a thing"]
    assert [chunker.is_heading(x) for x in yes] == [True] * len(yes) and [chunker.is_heading(x) for x in no] == [False] * len(no)
    assert pages.reflow("a\n\n\n\nb-\nc self-\nmade e-\nmail Fourier-\nTransform  x\ty") == "a\n\nbc self-made e-mail Fourier-Transform x\ty".replace("bc", "b-c")
    assert pages.without_furniture(["", "1", "x", "2", "", "3"], [False, True, False, True, False, True]) == ["", "", "x", "", "", ""]
    assert answers.renumber("a [ 2 ; 1 ] b [x] c [1 - 2] [1abcd2] [7]. \t[2] ,", 2) == ("a [1][2] b [x] c [1abcd2]. [1],", [2, 1])


def test_rerank_keeps_unusable_orders(spark):
    hits = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "a", 1)], "query_id string, key string, place int")
    orders = spark.createDataFrame([("1", ["b"]), ("2", [])], "query_id string, order array<string>")
    assert {(r.query_id, r.key, r.place) for r in router.reranked(hits, orders).collect()} == {("1", "b", 1), ("2", "a", 1)}


def test_sources_of_a_page(spark):
    rows = [("d", 1, "x" * 100), ("d", 2, "سلام " * 30), ("d", 3, "y" * 100), ("e", 1, "")]
    p = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    ocr = spark.createDataFrame([("d", 3, [("read", 0.9), ("bad", 0.2), (" ", None), ("too", None)])], "doc_id string, page_number int, lines array<struct<text:string,conf:double>>")
    spans = spark.createDataFrame([("d", 2, [["a", "b"], [], [" : ", "الاجازات", " ", "انواع"]]), ("d", 1, [["z"]])], "doc_id string, page_number int, spans array<array<string>>")
    sourced = pages.with_ocr(p, ocr, spans)
    assert {(r.doc_id, r.page_number): (r.source, r.text) for r in sourced.collect()} == {("d", 1): ("text", "x" * 100), ("d", 2): ("reordered", "ab\nانواع الاجازات : "), ("d", 3): ("ocr", "read\ntoo"), ("e", 1): ("empty", "")}
    assert [r.doc_id for r in pages.empty_documents(sourced).collect()] == ["e"]


def test_tables_and_captions(spark):
    p = spark.createDataFrame([("d", 1, "Body. Figure 2 here \n"), ("d", 2, "Other")], "doc_id string, page_number int, text string")
    tables = spark.createDataFrame([("d", 1, 0, [["a", None, "b"], [" ", ""], ["c", "d", "e"]])], "doc_id string, page_number int, pos int, rows array<array<string>>")
    captions = spark.createDataFrame([("d", 1, 0, "Figure 2 here"), ("d", 1, 1, " Table 1: x "), ("d", 2, 0, "no caption")], "doc_id string, page_number int, pos int, text string")
    assert {r.page_number: r.text for r in pages.with_extras(p, tables, captions).collect()} == {1: "Body. Figure 2 here\n\na |  | b\nc | d | e\n\nTable 1: x", 2: "Other"}


def test_pages_are_read_once(spark, tmp_path):
    def reader(batch):
        if b"bad" in batch:
            raise ValueError
        return [[(b.decode(), 0.8)] for b in batch]

    images = spark.createDataFrame([("d", k, bytearray(x)) for k, x in ((1, b"one"), (2, b"bad"), (3, b"three"), (3, b"three"), (0, b"none"), (4, b"four"))], "doc_id string, page_number int, image binary")
    cache = spark.createDataFrame([("d", 4, [("kept", 1.0)]), ("z", 1, [("other", 1.0)])], "doc_id string, page_number int, lines array<struct<text:string,conf:double>>")
    got = {r.page_number: [x.text for x in r.lines] for r in files.ocr_pages(images, reader, cache).collect()}
    assert got == {1: ["one"], 2: [], 3: ["three"], 4: ["kept"]}


def test_extraction_is_cached_counted_and_goes_across(spark, tmp_path):
    from lodestone import models

    e = Engine(spark, f"file://{tmp_path}/s")
    sentence = "Water boils at one hundred degrees at sea level, as measured often."
    rows = spark.createDataFrame([("good", "g", 1, sentence), ("bad", "b", 1, "This chunk makes the model fail whatever it is that is asked about it."), ("none", "n", 1, "This chunk has no question that anybody could ask, it seems.")], ROWS)

    def ask(text, before, after):
        if "fail" in text:
            raise RuntimeError("no answer")
        if "no question" in text:
            return "[]"
        return '<think>x</think>```json\n{"pairs": [{"question": "When does water boil", "answer": "' + sentence + '", "evidence": ["' + sentence + '"], "question_type": "factual"}]}\n```'

    first = e.ingest(rows, extract=models.model_extractor(ask), fingerprint="m1")
    row = e.last_coverage.first()
    assert first["n_questions"] == 1 and (row.chunks, row.chunks_failed, row.chunks_empty, row.pairs_kept, row.questions_per_chunk) == (3, 1, 1, 1, 0.33) and "no answer" in row.failure_samples[0]

    def never(text, before, after):
        raise AssertionError("asked again")

    assert e.ingest(rows, force=True, extract=models.model_extractor(never), fingerprint="m1")["n_questions"] == 1
    assert e.last_coverage.first().chunks_failed == 1
    assert e.ingest(rows, force=True, extract=models.model_extractor(never), fingerprint="m2")["n_questions"] == 1  # asked again, failed, and what was there stays
    assert e.last_coverage.first().chunks_failed == 3
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert models.with_retries(flaky, wait=0.0)("q") == "ok" and len(calls) == 3


def test_command_line(spark, tmp_path, capsys):
    import json

    from lodestone import __main__ as cli

    spark.createDataFrame([(1, "Bread dough rises because yeast makes carbon dioxide in a warm kitchen. Salt slows it down.")], "doc_id int, text string").write.parquet(f"{tmp_path}/docs")
    base = ["--store", f"file://{tmp_path}/s"]
    cli.main([*base, "ingest", f"{tmp_path}/docs"])
    cli.main([*base, "ask", "What is said about Bread dough rises because yeast makes carbon dioxide in?"])
    cli.main([*base, "documents"])
    cli.main([*base, "delete", "1"])
    cli.main([*base, "stats"])
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert out[0]["n_documents"] == 1 and out[1]["answered"] and out[1]["citations"] and out[2]["doc_id"] == "1" and out[3]["n_documents"] == 0
