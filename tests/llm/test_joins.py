"""Joins, searches and removals against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import collision, components, jaccardjoin, suffixdedup

NO_ID = -(1 << 63)


def classes(docs):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.setdefault((d, t), frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    keys = list(sets)
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k in keys:
        least[root(k)] = min(least.get(root(k), 1 << 62), NO_ID if k[0] is None else k[0])
    return Counter((d, len(sets[d, t]), None if least[root((d, t))] == NO_ID else least[root((d, t))]) for d, t in docs)


@pytest.fixture(scope="module")
def copies():
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    line, ids, docs = text(9), r.sample(range(100000), 1000), []
    for n in (1, 2, 5, 30):
        base = text(r.randrange(20, 90))
        for _ in range(n):
            b = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                b[r.randrange(len(b))] = f"q{r.randrange(10**6)}"
            docs.append((ids.pop(), " ".join((line if r.random() < 0.3 else []) + b)))
    chain = text(50)
    for k in range(15):
        chain = chain[1:] + [r.choice(words)]
        docs.append((ids.pop(), " \n".join(chain).upper() if k % 2 else " ".join(chain)))
    docs += [(ids.pop(), " ".join(line + text(r.randrange(6)))) for _ in range(25)]
    docs += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), docs[0], (7, docs[1][1]), (7, docs[2][1]), (None, docs[3][1])]
    return docs


@pytest.mark.parametrize(("tokens", "pivots"), [(1_000_000, 8), (900, 3)])
def test_jaccard_classes(spark, copies, tokens, pivots):
    df = spark.createDataFrame([(*d, 5) for d in copies], "doc_id long, text string, n long").repartition(3)
    assert Counter(map(tuple, jaccardjoin.join(df, region_tokens=tokens, pivots=pivots, frequent=0.05).collect())) == classes(copies)


def test_passages_alone_make_no_region(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    passages = [[word() for _ in range(14)] for _ in range(12)]
    docs = []
    for k in range(400):
        a, b = r.sample(passages, 2)
        docs.append((k, " ".join([word() for _ in range(6)] + a + [word() for _ in range(6)] + b)))
    docs += [(1000 + k, docs[k][1] + " " + word()) for k in range(3)]
    large, split = [], jaccardjoin.split_regions
    monkeypatch.setattr(jaccardjoin, "split_regions", lambda sets, *a: large.append(sets.count()) or split(sets, *a))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, jaccardjoin.join(df, frequent=0.5, region_tokens=3000).collect())) == classes(docs)
    assert large == [0]  # each passage is held by some 67 documents, which have nothing else in common


def test_jaccard_of_nothing(spark):
    assert jaccardjoin.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (101, 102), (102, 100), (200, 200), (50, 60), (60, 50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100, 50: 50, 60: 50}


def removals(docs, length=100):
    rows = {(d, t) for d, t in docs}
    order = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w, k = b[i : i + length], (order(d), i)
            if w not in first or k < first[w]:
                first[w] = k
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (order(d), i):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out[d, t] = len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
    return Counter((d, *out[d, t]) for d, t in docs)


@pytest.fixture(scope="module")
def repeats():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 8))) for _ in range(150)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages, docs = [text(r.randrange(15, 50)) for _ in range(8)], []
    for _ in range(90):
        parts = []
        for _ in range(r.randrange(1, 5)):
            p, x = r.choice(passages), r.random()
            parts.append(p[r.randrange(20) : len(p) - r.randrange(30)] if x < 0.5 else r.choice("ab") * r.randrange(90, 240) if x < 0.6 else text(r.randrange(3, 30)))
        docs.append((r.randrange(10000), r.choice([" ", "", "\n"]).join(parts)))
    return docs + [(5, docs[0][1]), (5, docs[0][1]), (6, None), (7, ""), (8, "x" * 99), (9, "x" * 100), (10, "y" * 400), (None, docs[1][1]), (11, docs[2][1] * 3)]


@pytest.mark.parametrize("crowd", [1000, 2])
def test_repeats_are_removed(spark, repeats, crowd):
    df = spark.createDataFrame([(*d, "clash") for d in repeats], "doc_id long, text string, n_bytes string").repartition(3)
    got = suffixdedup.dedup(df, digest=True, crowd=crowd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removals(repeats)


def test_rows_of_repeats_follow_the_blocks_they_go_to(repeats):
    docs = [(d or 0, k, t) for k, (d, t) in enumerate(repeats) if t]
    batch = pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*docs), (pa.int64(), pa.int32(), pa.string()))], names=["__id", "__text_key", "text"])
    rows = [r for out in suffixdedup.anchor_rows(100, blocks=4)([batch]) for r in out.to_pylist() if r["kind"] == suffixdedup.REPEATS]
    assert 0 < len(rows) <= 4 and len({r["block"] for r in rows}) == len(rows)


def test_repeats_of_nothing(spark):
    assert suffixdedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_merge_like_a_sort():
    r = random.Random(9)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(0, 30))) for _ in range(7)]
    coded = [([suffixdedup.common_prefix(a, b) for a, b in zip([b"", *x], x)], x) for x in runs]
    which, at, shared = suffixdedup.merge(coded)
    out = [runs[w][k] for w, k in zip(which, at)]
    assert out == sorted(s for x in runs for s in x)
    assert shared == [suffixdedup.common_prefix(a, b) for a, b in zip([b"", *out], out)]


def test_run_round_trip():
    items = [(b"abcd", b"xy", 1, 2, 3, 0, 2), (b"abce", b"z", -5, 6, 7, 1, 1), (b"abcd", b"", 8, 9, 10, 0, 0)]
    columns, suffixes, before = suffixdedup.read_run(suffixdedup.write_run(list(items)))
    assert suffixes == [b"abcd", b"abcd", b"abce"] and before == [b"xy", b"", b"z"] and columns[0].tolist() == [1, 8, -5]


def test_nearest_neighbours(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(600, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [1.0, 2.0]), (1001, v[5].tolist()), (5, v[5].tolist()), (1002, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = collision.search(df, df.where("vec_id % 20 = 0"), vector_block=250, query_block=20).collect()
    real = {k: np.array(x, np.float64) for k, x in rows if k < 600 or k == 1001}
    hit = total = 0
    for q in range(0, 600, 20):
        best = sorted((float(np.sqrt(((real[k] - real[q]) ** 2).sum())), k) for k in real if k != q)[:10]
        own = sorted((x.rank, x.vec_id, x.score) for x in found if x.query_id == q)
        assert [x[0] for x in own] == list(range(1, 11)) and [x[2] for x in own] == sorted(x[2] for x in own)
        assert all(abs(s - float(np.sqrt(((real[k] - real[q]) ** 2).sum()))) < 1e-12 for _, k, s in own)
        hit, total = hit + len({k for _, k in best} & {x[1] for x in own}), total + 10
    assert hit / total >= 0.9 and not {700, 800, 900, 1002} & {x.query_id for x in found}
    assert collision.search(df.where("false"), df.where("false")).count() == 0


def test_nearest_neighbours_of_repeated_ids(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    crowd = [(500, (v[0] + 1e-3 * r.normal(size=16)).tolist()) for _ in range(40)]
    rows = 2 * [(k, x.tolist()) for k, x in enumerate(v)] + crowd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collision.search(df, df.where("vec_id % 20 = 0 and vec_id < 300")).collect()
    hit = 0
    for q in range(0, 300, 20):
        far = {}
        for k, x in rows:
            if k != q:
                far[k] = min(far.get(k, np.inf), float(np.sqrt(((np.array(x) - v[q]) ** 2).sum())))
        own = sorted((x.rank, x.vec_id, x.score) for x in found if x.query_id == q)
        assert [x[0] for x in own] == list(range(1, 11)) and len({x[1] for x in own}) == 10
        assert all(abs(s - far[k]) < 1e-9 for _, k, s in own)
        hit += len({x[1] for x in own} & set(sorted(far, key=far.get)[:10]))
    assert hit >= 0.9 * 150


def test_words_of_like_polynomials_stay_apart(spark):
    """Two words whose bytes agree in every polynomial modulo 2**64: a Thue-Morse word and its complement."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, other = ("".join("ab"[b ^ f] for b in bits) for f in (0, 1))
    df = spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string")
    assert sorted(map(tuple, jaccardjoin.join_query(df).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_word_hash_depends_on_all_bytes_and_the_length():
    from lodestone.llm.bytekit import word_hash

    words = [b"a" * k for k in range(1, 40)] + [b"a" * k + b"\0" for k in range(1, 20)] + [b"b" + b"a" * k for k in range(1, 40)] + [b"a" * k + b"b" for k in range(1, 40)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    start = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    got = word_hash(data, start, start + np.array([len(w) for w in words]), 7)
    assert len(set(got.tolist())) == len(set(words))
    again = word_hash(np.frombuffer(b"xx" + b" ".join(words), np.uint8), start + 2, start + 2 + np.array([len(w) for w in words]), 7)
    assert (got == again).all()


def test_long_texts_and_extra_columns_are_joined(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(60_000))
    near = long.replace("w17 ", "w18 ")
    df = spark.createDataFrame([(3, long, 1, "x"), (1, near, 2, None), (2, "short one", 3, "y")], "doc_id long, text string, component_id int, n string")
    assert {r.doc_id: r.component_id for r in jaccardjoin.join(df).collect()} == {1: 1, 3: 1, 2: 2}


def test_windows_leave_few_vectors_to_verify():
    """Vectors without clusters, the hardest case: recall and the share of vectors that are verified."""
    v = np.random.default_rng(4).normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = collision.Index(v, collision.DIRECTIONS)
    hit, queries = 0, range(0, 6000, 150)
    for q in queries:
        at, distance = index.nearest(v[q], 10, np.array([q]))
        far = np.sqrt(((v - v[q]) ** 2).sum(1))
        far[q] = np.inf
        hit += len(set(np.argsort(far)[:10].tolist()) & set(at[np.argsort(distance)][:10].tolist()))
    assert hit / (10 * len(queries)) >= 0.9 and index.verified / (len(queries) * len(v)) < 0.2


def test_nearest_of_null_ids_clashing_columns_and_large_values(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=4) * 1e200], k, 0.5) for k in range(40)] + [(None, [1e200, 0.0, 0.0, 0.0], 1, 1.0), (100, [1e308] * 4, 2, 2.0), (100, [-1e308] * 4, 2, 2.0), (100, [0.0, 1e200, 0.0, 0.0], 3, 3.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    found = collision.search(df, df.where("vec_id % 20 = 0 or vec_id is null"), k=5).collect()
    again = collision.search(df.repartition(3), df.where("vec_id % 20 = 0 or vec_id is null"), k=5).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again)) and {x.query_id for x in found} == {0, 20, 100}
    v = {k: np.array(x) for k, x, _, _ in rows if k is not None and k < 100}
    for q in (0, 20):
        best = sorted((float(np.sqrt((((v[k] - v[q]) / 1e200) ** 2).sum())) * 1e200, k) for k in v if k != q)[:5]
        assert len({x.vec_id for x in found if x.query_id == q} & {k for _, k in best}) >= 4
