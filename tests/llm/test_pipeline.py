"""The pipeline's stages on a small table, each held against what it must decide."""

import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.test_joins import classes


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = [f"wort{k}" for k in range(400)]
    out = [(k, " ".join(r.choice(words) for _ in range(r.randrange(30, 80))), "en", f"s{k % 3}") for k in range(60)]
    out += [(100 + k, out[k][1] + " more", "en", "s0") for k in range(5)] + [(200, out[6][1] + " | " + out[7][1], "en", "s1"), (300, "12 34 56", "en", "s0"), (301, None, None, None)]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in out]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeats", "mixing", "tokens"]
    seen, left = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        left = spark.createDataFrame(stage(spark, left, "").collect(), stage(spark, left, "").schema)
        seen[name] = left.collect()
        assert name == "tokens" or left.columns == docs.columns
    ids = {n: [r.doc_id for r in x] for n, x in seen.items()}
    assert set(ids["language"]) == {r[0] for r in rows} - {300, 301}
    want = {c[2] for c in classes([(r[0], r[1]) for r in rows if r[0] < 300])}
    assert sorted(ids["near_duplicates"]) == sorted(want) and not set(range(100, 105)) & want
    text = {r.doc_id: r.text for r in seen["repeats"]}
    assert len(text.get(200, "")) < 20 and all(text[k] == rows[k][1] for k in range(8))
    assert set(ids["mixing"]) <= set(text) and max(ids["mixing"].count(k) for k in set(ids["mixing"])) <= 2
    for r in seen["tokens"]:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_near_duplicates_of_null_and_repeated_ids(spark):
    r = random.Random(9)
    a, b, c, d, e = (" ".join(r.choice("abcdefghijklmnop") + str(r.randrange(900)) for _ in range(60)) for _ in range(5))
    rows = [(1, a), (5, a + " more"), (5, b), (6, b + " more"), (None, c), (None, d), (None, d), (None, d + " more"), (7, c + " more"), (8, e), (8, e), (9, ""), (9, None)]
    for turn in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", 1) for k, (i, t) in enumerate(turn)], "doc_id long, text string, lang string, source string, n_chars long")
        got = [(x.doc_id, x.text) for x in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
        texts = [t for i, t in got if i is None]
        # of d and its near copy, both without an id, either may stay
        assert len(texts) == 2 and c in texts and {d, d + " more"} & set(texts)
        assert sorted((x for x in got if x[0] is not None), key=str) == sorted([(1, a), (5, b), (8, e), (9, ""), (9, None)], key=str)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "ein Text", None, "s", 8), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (4, "слово", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 4]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_stage_takes_all_cases(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that clash with what the operators make."""
    r = random.Random(10)
    text = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(9000)) for _ in range(n))
    long, plain = text(60_000), text(50)
    rows = [(1, long, "en", "s", len(long)), (2, plain, None, None, None), (2, plain, None, None, None), (None, text(40), "en", "s", 3), (None, None, None, None, None), (4, "", "de", "s", 0), (5, text(30), "de", "t", 1)]
    docs = spark.createDataFrame([(*x, 1.5, "c", 7, None) for x in rows], f"{SCHEMA}, position double, component_id string, size int, n_removed string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        if name == "tokens":
            assert len(got) == len(rows) and {x.n_tokens for x in got if x.doc_id in (4,)} == {0}
            continue
        assert out.columns == corpus_pipeline.COLUMNS and {x.doc_id for x in got} >= {1, 2, 5} and next(x for x in got if x.doc_id == 1).text == long
        kept = sum(x.doc_id == 2 for x in got)
        assert kept >= 2 if name == "language" else kept == 1 if name == "near_duplicates" else kept >= 2 if name == "repeats" else kept >= 1
        assert (None in {x.text for x in got}) == (name == "near_duplicates")


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run_drops_what_it_passes_through(spark, rows, tmp_path, monkeypatch):
    import os

    from lodestone.llm import store

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(store, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = sorted(x.rsplit("-", 1)[0] for x in os.listdir(f"{tmp_path}/shared"))
    assert left == ["stage-mixing"] and out.count() > 40
