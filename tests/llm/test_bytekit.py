"""Byte helpers and the text-only operators against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import anchors, bpe, bytekit, htmltext, langid, toxicity


def test_span_hash_does_not_depend_on_place():
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    p = bytekit.prefix_hash(data, bytekit.byte_codes(1))
    a, b, c, d = bytekit.span_hash(p, np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert a == b == c != d


def test_raw_reads_slices_and_nulls():
    column = pa.array(["x", None, "éa", ""]).slice(1)
    data, offsets = bytekit.raw(column)
    assert data.tobytes() == "éa".encode() and offsets.tolist() == [0, 0, 3, 3]


def test_pieces_cover_all_rows():
    offsets = np.array([0, 5, 5, 50, 51, 52])
    assert [x for a, b in bytekit.pieces(offsets, 10) for x in range(a, b)] == list(range(5))
    assert list(bytekit.pieces(np.array([0]), 10)) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_windows_have_equal_anchors(seed):
    r = random.Random(seed)
    common = bytes(r.choice(b"abcd ") for _ in range(300))
    texts = [bytes(r.choice(b"abcd ") for _ in range(r.randrange(0, 90))) + common[r.randrange(50) : 300 - r.randrange(50)] for _ in range(6)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    a = anchors.find(data, offsets, 100)
    seen = {}
    for row, first, last, gram in zip(a.row, a.first, a.last, a.gram):
        for s in range(first, last + 1):
            assert seen.setdefault(texts[row][s : s + 100], gram) == gram
    assert sum(a.last - a.first + 1) == sum(max(0, len(t) - 99) for t in texts)


def test_long_texts_have_the_same_anchors(monkeypatch):
    """Texts beyond the places that a hash can carry are cut into stretches; equal windows still share their k-gram."""
    monkeypatch.setattr(anchors, "PLACE_BITS", 10)
    r = random.Random(5)
    common = bytes(r.choice(b"abcd ") for _ in range(900))
    texts = [bytes(r.choice(b"abcd ") for _ in range(n)) + common for n in (0, 700, 3000, 5)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    a = anchors.find(np.frombuffer(b"".join(texts), np.uint8), offsets, 100)
    seen = {}
    for row, first, last, gram in zip(a.row, a.first, a.last, a.gram):
        for s in range(first, last + 1):
            assert seen.setdefault(texts[row][s : s + 100], gram) == gram
    assert sum(a.last - a.first + 1) == sum(len(t) - 99 for t in texts)


@pytest.fixture(scope="module")
def codec():
    P = pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, bpe.Codec(*bpe.serialise_model(ranks), P.PATTERN), P.PATTERN


def test_ids_equal_the_reference_encoder(codec):
    import tiktoken

    ranks, own, pattern = codec
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["", " ", "a  \n\n b", "I'll don't", "日本語 🎉", "\x00\x1c\x85", "a" * 3000, "<|endoftext|>"]
    texts += ["".join(chr(r.choice([r.randrange(1, 0x500), r.randrange(0x20, 0x7F), r.randrange(0x1F300, 0x1F700)])) for _ in range(200)) for _ in range(60)]
    for t, ids in zip(texts, own.encode_batch(texts)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_frames(spark, codec):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, "Hello wörld", "x"), (2, None, None), (3, "", "z"), (3, "", "z"), (4, "long " * 30000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in out) == sorted((k, (t or "").encode()) for k, t, _ in rows)
    digest = {r.doc_id: r for r in bpe.digest_query(df.drop("ids"), path, P.PATTERN).collect()}
    assert digest[2].n_tokens == 0 and digest[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert digest[1].decoded_sha256 == hashlib.sha256("Hello wörld".encode()).hexdigest()
    assert bpe.digest_query(df.drop("ids").where("false"), path, P.PATTERN).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>One   <b>bold</b>
word.<br>Next.<p>Short.</p><div class="ad">Buy now</div><!-- x --><p>Caf&eacute; &#8364;5 <a href="#">link</a> here</p><section id="comments"><p>Nice article, thanks for it all</p></section></article>
<aside>More</aside><form><label>Mail</label></form><footer>&copy; us</footer><p cut"""


def test_html_article_only():
    tree = htmltext.fit()
    assert htmltext.extract_many([PAGE], tree) == ["Head & line\n\nOne bold word. Next.\n\nShort.\n\nCafé €5 link here"]
    assert htmltext.extract_many([None, "", "<p", "plain words only", "<nav>" + "x " * 99], tree)[:3] == ["", "", ""]


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, None), (3, "u", "<p>" * 5000 + "x", "c"), (3, "u", "<p>" * 5000 + "x", "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extraction_query(df).collect()}
    assert got[1].text.startswith("Head & line") and got[2].text == "" and got[2].n_chars == 0
    assert htmltext.extraction_query(df.where("false")).count() == 0


def _language_rows(n):
    r = random.Random(5)
    words = {"en": "the and of with that this from".split(), "fr": "le des une qui avec être où".split(), "de": "der und nicht für mit ß ü".split()}
    return [(k, " ".join(r.choice(words[c]) for _ in range(r.randrange(5, 90))), c) for k in range(n) for c in [r.choice(sorted(words))]]


def test_language_is_learnt_and_held_out(spark):
    rows = _language_rows(400) + [(900, None, "en"), (901, "12 34", "fr"), (902, "the and of " * 20000, None), (903, "", "de"), (903, "", "de")]
    got = langid.language_query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [(lang, by[k].lang_pred) for k, t, lang in rows[:400] if by[k].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.97
    assert by[900].lang_pred == by[901].lang_pred == by[903].lang_pred == "und" and by[902].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.language_query(df).collect()] == [("und", 0.0)]
    assert langid.language_query(df.where("false")).count() == 0


def test_toxicity_is_learnt_and_held_out(spark):
    r = random.Random(6)
    filler = ["".join(r.choice("aeioustrn") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    rows, marks = [], []
    for k in range(500):
        words = [r.choice(filler) for _ in range(r.randrange(20, 80))]
        bad = k % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "moron"]))
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad)))
    rows += [(900, None), (901, ""), (902, "nice " * 50000), (1, rows[1][1])]
    marks += [(900, None), (None, 1), (1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity_query(docs, labels).collect()
    truth = dict(marks[:500])
    held = [(truth[x.doc_id], x.predicted) for x in got if x.held_out and x.doc_id in truth]
    assert len(got) == len(rows) and len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    none = toxicity.toxicity_query(docs, labels.where("false")).collect()
    assert {x.score for x in none} == {0.5}
    assert toxicity.toxicity_query(docs.where("false"), labels).count() == 0


def test_words_are_cut_as_stated():
    from lodestone.llm import jaccardjoin

    t = "A\x0bb  c\xa0d\ne f g".encode()
    tokens, bounds = jaccardjoin.shingles(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    words = re.findall(r"[^\x20\x09-\x0D]+", t.decode())
    assert bounds[-1] == len(words) - 4


def test_toxicity_equals_a_dense_fit():
    """The sparse fit and score against sets of n-grams in a dense matrix."""
    r = random.Random(8)
    texts = ["".join(r.choice("abÄ é\t漢") for _ in range(r.randrange(0, 40))) + (" SCUM" if k % 3 == 0 else "") for k in range(40)] + ["", "abc"]
    labels = [int(k % 3 == 0) for k in range(40)] + [0, 0]
    place = {}

    def grams(t):
        x = [toxicity.FOLD[ord(c)] if ord(c) < toxicity.CASED else ord(c) for c in t]
        return {int(toxicity.hashed(np.array(x[i : i + n], np.uint32))[-1]) for n in toxicity.LENGTHS for i in range(len(x) - n + 1)}

    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
    for g in sorted(set().union(*map(grams, texts))):
        place[g] = len(place)
    x, y = np.zeros((len(texts), len(place))), np.array([labels[i] for i in order], float)
    for row, i in enumerate(order):
        x[row, [place[g] for g in grams(texts[i])]] = 1
    s, n = toxicity.SMOOTHING, len(y)
    ratio = np.log((x[y == 1].sum(0) + s) / (y.sum() + 2 * s)) - np.log((x[y == 0].sum(0) + s) / (n - y.sum() + 2 * s))
    scaled = x * ratio / np.sqrt(((x * ratio) ** 2).sum(1).mean())
    w, b, vw, vb = np.zeros(len(place)), np.log((y.sum() + 1) / (n - y.sum() + 1)), 0.0, 0.0
    for _ in range(60):
        g = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum())) * (1 / (1 + np.exp(-(scaled @ w + b))) - y)
        vw, vb = 0.9 * vw + scaled.T @ g + 1e-4 * w, 0.9 * vb + g.sum()
        w, b = w - 10 * vw, b - 10 * vb
    model = toxicity.train(texts, labels)
    features = toxicity.Features()
    for row, i in enumerate(order):
        assert abs(model.intercept + model.weight[features(texts[i].encode())].sum() - (scaled[row] @ w + b)) < 1e-3


def test_language_tables_equal_a_plain_convolution():
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(97, 123, r.integers(1, 600), dtype=np.uint8)) for _ in range(12)]
    net = langid.train(texts, ["a", "b", "c"] * 4, epochs=1)
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = langid.Predictor(net).documents(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for t, p in zip(texts, got):
        each = []
        for a in range(0, len(t), langid.WINDOW):
            x = [int(langid.FOLD[c]) for c in t[a : a + langid.WINDOW].ljust(langid.WINDOW, b"\0")]
            pooled = [max(float(np.concatenate([net.embed[c] for c in x[k : k + w]]) @ f[:, j]) for k in range(len(x) - w + 1)) for w, f in zip(langid.WIDTHS, net.filters) for j in range(langid.FILTERS)]
            z = np.maximum(np.array(pooled) + net.bias, 0) @ net.dense + net.out
            each.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        assert np.allclose(np.mean(each, 0), p, atol=1e-4)


def test_classifiers_on_long_and_clashing_rows(spark):
    rows = [(k, t, lang, 0.5, "x", k % 2) for k, t, lang in _language_rows(60)] + [(900, "the idiot " * 60000, "en", None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, toxic int")
    a, b = langid.language_query(docs).collect(), toxicity.toxicity_query(docs, docs.select("doc_id", "toxic")).collect()
    assert len(a) == len(b) == len(rows) and len({(r.lang_pred, r.score) for r in a if r.doc_id == 900}) == len({r.score for r in b if r.doc_id == 900}) == 1
