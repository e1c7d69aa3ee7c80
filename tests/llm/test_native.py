"""Native operators against their SQL and against cases written by hand."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, quality, registry, urlfilter
from tests.test_catalogue import held_against_sql


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    held_against_sql(spark, sf, registry.queries()[name], registry.oracle_sql()[name])


def test_no_python_in_native_plans(spark, sf):
    for name in ("op4_quality", "op5_urls", "op8_mixing"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_url_rules(spark):
    urls = [
        "https://www.Example.COM/en/7/x?y", "http://example.com/en/8", "http://com/en/", "http://telecom/en/1", "http://example.net/de/8", "https://a.b.net/de/1#f", "http://x.org/es", "http://x.org/es/",
        None, "", "no scheme/en/", "http://", "http://x.com:80/en/1", "a://b://c.net/de/x", "http://x.com?/en/", "http://com./en/1", "http://x.com-foo.com/en/",
    ]
    rules = urlfilter.RULES

    def plain(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    rows = [(k, u, "clash") for k, u in enumerate(urls)] + [(0, urls[0], "clash")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), urlfilter.rule_table(spark)).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((k, *plain(u)) for k, u, _ in rows)
    assert urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), urlfilter.rule_table(spark).where("false")).where("verdict <> 'allow'").count() == 0
    assert urlfilter.url_query(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 1), (0, 100), (3, 200), (10, 1000), (40, 20000), (90, 20000), (7, 10)]
    p = 0.005
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()
    for r in got:
        want = 1.0 if r.k > r.n * p else sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log1p(-p)) for i in range(r.k + 1))
        assert r.t == pytest.approx(want, rel=1e-9)


def test_quality_counts_and_cases(spark):
    text = "a b c a b c d\n\nx\nx\n #$ \nx"
    rows = [(1, text, "en"), (2, None, "en"), (3, "", None), (4, "word " * 30000, "xx"), (4, "word " * 30000, "xx"), (None, "é " * 60, "en")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, n_words long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    one = got[1]
    assert (one.n_words, one.word_chars, one.n_symbols, one.n_dup_lines, one.n_repeat_words) == (11, 12, 2, 2, 6)
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept and got[4].n_repeat_words == 30000 and got[4].base_failed
    assert quality.quality_query(docs.where("false"), labels).count() == 0


def test_quality_cutoffs_spare_good_texts(spark):
    rows, marks = [], []
    for k in range(1500):
        bad = k % 5 == 0
        rows.append((k, " ".join(f"w{k}x{i}" + ("###" if bad else "") for i in range(60)), "en"))
        marks.append((k, int(not bad)))
    out = quality.quality_query(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int"))
    kept = Counter((r.doc_id % 5 == 0, r.kept) for r in out.collect())
    assert kept == {(True, False): 300, (False, True): 1200}


def test_mixing_targets_and_takes(spark):
    rows = [(k, "w " * (k % 9), f"s{k % 3}") for k in range(400)] + [(900, None, "s0"), (901, "x", None), (902, "w " * 50000, "s1"), (903, "", "zero"), (5, "w " * 5, "s2")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, target double")
    got = mixing.mix(docs, keep_text=False).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and len(r.positions) == -(-r.taken // max(1, r.size)) and all(0 <= p <= 1 for p in r.positions)
    goal, cap = 1.5 * sum(sizes.values()), {s: 2 * n for s, n in sizes.items()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, fixed = {}, {}
    while True:
        free = {s: w for s, w in weight.items() if s not in fixed}
        left = goal - sum(fixed.values())
        want = fixed | {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in free if want[s] > cap[s]}
        if not over:
            break
        fixed |= {s: cap[s] for s in over}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(7), keep_text=False).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.mixing_query(docs.where("false")).count() == 0


def test_schedules_are_inverted(spark):
    for k, knots in enumerate(mixing.SCHEDULES):
        area = lambda t: sum((min(t, b) - a) * (u + u + (v - u) * (min(t, b) - a) / (b - a)) / 2 for (a, u), (b, v) in zip(knots, knots[1:]) if t > a)  # noqa: E731, B023
        shares = [x / 20 for x in range(21)]
        times = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "x double").select(mixing.time_of(F.col("x"), F.lit(k))).collect()]
        assert [area(t) / area(1.0) for t in times] == pytest.approx(shares, abs=1e-9)


def certified_by_hand(rows, marks):
    """Cutoffs of each language by the exact binomial test in a fixed sequence, in plain Python."""
    facts = {}
    for d, text, lang in rows:
        words = text.split()
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.split()]
        if len(words) >= 50 and 100 * len(again) <= 50 * len(words):
            facts[d] = lang, {"symbols": sum(text.count(c) for c in quality.SYMBOLS) / len(words), "lines": (len(lines) - len(set(lines))) / len(lines), "repeats": len(again) / len(words), "length": sum(map(len, words)) / len(words)}
    strata = {facts[d][0] for d in marks if d in facts}
    out = {}
    for lang in strata:
        good = [facts[d][1] for d, q in marks.items() if d in facts and facts[d][0] == lang and q]
        bad = [facts[d][1] for d, q in marks.items() if d in facts and facts[d][0] == lang and not q]
        for signal, grid in quality.GRID.items():
            best = (0, None)
            for c in grid:
                k, n, p = sum(x[signal] > c for x in good), len(good), quality.RISK / len(quality.GRID)
                tail = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if n and k <= n * p else 1.0
                if tail > quality.DELTA / (len(quality.GRID) * len(strata)):
                    break
                gain = sum(x[signal] > c for x in bad) - k
                best = max(best, (gain, c), key=lambda x: x[0])
            out[lang, signal] = best[1]
    return {d: not any(out.get((lang, s)) is not None and v > out[lang, s] for s, v in x.items()) for d, (lang, x) in facts.items()}, out


def test_certified_cutoffs_equal_sql_and_the_exact_test(spark, tmp_path):
    """Enough labels to certify cutoffs in one language, too few in another."""
    import duckdb

    r = random.Random(3)
    rows, marks = [], {}
    for k in range(2600):
        lang = "de" if k % 13 == 0 else "en"
        bad, few = k % 4 == 0, r.random() < 0.004
        extra = r.choice(["#", "#*|", "%%%%"]) if bad or few else ""
        line = "the same line again\n" * (8 if bad and k % 8 == 0 else 0)
        rows.append((k, line + " ".join(f"{'long' * (4 if bad and k % 12 == 0 else 1)}{k}x{i}{extra}" for i in range(60)), lang))
        marks[k] = int(not bad)
    kept, cutoffs = certified_by_hand(rows, marks)
    assert {lang for (lang, _), c in cutoffs.items() if c is not None} == {"en"} and sum(c is not None for c in cutoffs.values()) >= 2
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.quality_query(docs, labels).collect()}
    assert {d: got[d] for d in kept} == kept and 300 < sum(not v for v in got.values()) < 800
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    out = con.execute(quality.quality_sql())
    names = [c[0] for c in out.description]
    assert {row[names.index("doc_id")]: row[names.index("kept")] for row in out.fetchall()} == got


def test_training_order_is_total(spark):
    docs = spark.createDataFrame([(k % 50, "w " * (k % 5), f"s{k % 4}") for k in range(300)], "doc_id long, text string, source string")
    runs = [[(x.doc_id, x.source, x.position) for x in mixing.in_training_order(mixing.mix(docs.repartition(n))).collect()] for n in (1, 6)]
    assert runs[0] == runs[1] and [x[2] for x in runs[0]] == sorted(x[2] for x in runs[0])
    rows = [x.position for x in mixing.mixing_query(docs).collect()]
    assert len(rows) == 300 and [x for x in rows if x is not None] == sorted(x for x in rows if x is not None) and rows.index(min(x for x in rows if x is not None)) == sum(x is None for x in rows)


def test_nested_rules_over_many_ranges(spark):
    """Rules nested in hosts and paths, a host with a third of all urls, and more ranges than rules of a host."""
    r = random.Random(2)
    label, part = (lambda: r.choice(["a", "b", "a-b", "c"])), (lambda: r.choice(["x", "xy", "é", "\n"]))
    rules = {(".".join(label() for _ in range(r.randrange(1, 4))), "/" * r.randrange(2) + "/".join(part() for _ in range(r.randrange(0, 3)))): r.choice(["allow", "block"]) for _ in range(40)}
    urls = [(k, f"http://{'b.a' if k % 3 == 0 else '.'.join(label() for _ in range(r.randrange(1, 5)))}/" + "/".join(part() for _ in range(r.randrange(0, 4)))) for k in range(600)]

    def plain(u):
        host, _, path = u[7:].partition("/")
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[2:] if fits else (None, "allow")

    table = spark.createDataFrame([(*k, v) for k, v in rules.items()] + [(None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    got = {x.page_id: (x.rule, x.verdict) for x in urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string"), table).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == {k: plain(u) for k, u in urls} and len({v for v, _ in got.values()}) > 10


def test_registered_rules_are_the_contract_s(spark):
    urls = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"), "http://b.example.net/de/80": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"), "http://a.org/en/": (None, "allow")}
    got = urlfilter.url_query(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")).collect()
    assert [(x.rule, x.verdict) for x in sorted(got, key=lambda x: x.page_id)] == list(urls.values())
