from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import importance_sampling, periodic_runs, queries, url_filter
from tests.llm.conftest import prose, words_of

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URLS = [
    "http://example.com/en/1", "https://www.example.com/en/1", "https://a.www.example.com/en/", "http://EXAMPLE.Com/EN/1", "http://example.com/en", "http://notexample.com/en/1",
    "http://a.net/es/x?y=/z#/w", "http://net/fr/", "http://a.net/de/", "http://a.net?x=/es/", "http://a.net#/es/", "//a.com/x", "a.com", "", None, "x://", "x:///p", "http://a.com",
    "http://a.com:80/x", "http://u@a.com/x", "see http://a.com/x://b.net/es/", "http://münchen.com/ä", "http://a\nb.net/fr/\n?x", "http://" + "a" * 50_000 + ".net/fr/" + "p" * 50_000,
]


def split_by_force(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def rule_by_force(host, path):
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.fit(queries.labelled_urls(spark))


def test_urls_and_rules_equal_brute_force(spark, url_model):
    rows = [(i, u, "x", 0.5) for i, u in enumerate([*URLS, URLS[0]])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, __score double")
    got = url_filter.judge(df, queries.URL_RULES, url_model, carry={"page_id": F.col("page_id")}).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split_by_force(rows[r.page_id][1])
        rule, verdict = rule_by_force(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score > 0.5 else "allow"))
    empty = [r for r in got if r.host == "" and r.path == ""]
    assert len({r.block_score for r in empty}) == 1 and {r.verdict for r in empty} == {"allow"}


def test_equally_long_rules(spark):
    rules = [url_filter.Rule("allow", "b.com", "/a/"), url_filter.Rule("block", "com", "/a/bb"), url_filter.Rule("block", "b.com", "/a/")]
    df = spark.createDataFrame([("http://x.b.com/a/bb",)], "url string")
    assert [(r.rule, r.verdict) for r in url_filter.judge(df, rules, None).collect()] == [("b.com/a/", "block")]
    assert [(r.rule, r.verdict, r.block_score) for r in url_filter.judge(df, [], None).collect()] == [(None, "allow", None)]


def grams_by_force(host, path):
    out = []
    for mark, part in (("h", host), ("p", path)):
        if part:
            whole = "^" + re.sub("[0-9]", "0", part) + "$"
            out += [mark + whole[i : i + n] for n in (3, 4, 5) for i in range(len(whole) - n + 1)]
    return sorted(out)


def test_grams_and_scores_equal_brute_force(spark, url_model):
    from pyspark.ml.feature import HashingTF

    urls = [u for u in URLS if u is None or len(u) < 1000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    shown = df.select("page_id", url_filter.url_grams(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("g")).collect()
    assert {r.page_id: sorted(r.g) for r in shown} == {i: grams_by_force(*split_by_force(u)) for i, u in enumerate(urls)}
    slot = HashingTF(numFeatures=url_filter.SLOTS).indexOf
    weights = url_model.coefficients.toArray()
    for r in url_filter.judge(df, [], url_model, carry={"page_id": F.col("page_id")}).collect():
        margin = url_model.intercept + sum(weights[s] for s in {slot(g) for g in grams_by_force(*split_by_force(urls[r.page_id]))})
        assert abs(r.block_score - 1 / (1 + math.exp(-margin))) < 1e-9


def test_unseen_hosts_are_told(spark, url_model):
    """Hosts that the labelled table doesn't have, in other shapes than its own."""
    bad = [f"https://{a}.{b}.info/index" for a in ("m", "new") for b in ("grandcasino", "poker-star", "livebets", "adtracker24", "pornhouse", "payday-loans4u", "superjackpot")]
    good = [f"https://{a}.{b}.info/index" for a in ("m", "new") for b in ("citylibrary", "old-gardens", "weatherline", "musicschool", "thehistory", "sciencetalk", "rivermaps")]
    df = spark.createDataFrame([(u, int(u in bad)) for u in bad + good], "url string, block int")
    got = url_filter.judge(df, [], url_model, carry={"block": F.col("block")}).collect()
    right = sum((r.verdict == "block") == bool(r.block) for r in got)
    assert right >= 0.9 * len(got)


def test_fit_on_odd_tables(spark):
    one = spark.createDataFrame([("http://a.com/", 1), (None, 0), ("http://b.com/", None)], "url string, block int")
    assert url_filter.fit(one) is None and url_filter.fit(one.where("false")) is None
    with pytest.raises(ValueError):
        url_filter.fit(one.withColumn("block", F.lit(2)))
    empty = one.where("false")
    assert url_filter.judge(empty, queries.URL_RULES, None).collect() == []


def test_url_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    df = queries.op11_url_filter(spark, sf_dir)
    got = df.collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        host, path = split_by_force(pages[r.page_id])
        rule, verdict = rule_by_force(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or verdict == r.verdict)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def features_by_force(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)], len(w)


def resample_by_force(docs, target, most, buckets, share, least, seed):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    s, t = [0] * buckets, [0] * buckets
    slot = lambda g: zlib.crc32(g.encode()) % buckets
    for rows, counts in ((docs, s), (target, t)):
        for _, text in rows:
            for g in features_by_force(text, most)[0]:
                counts[slot(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        grams, words = features_by_force(text, most)
        weight = sum(gain[slot(g)] for g in grams)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(grams), weight, score, words >= least])
    fits = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): n for n, r in enumerate(fits[: len(fits) * share[0] // share[1]], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize(("most", "buckets", "share", "least"), [(1, 50, (30, 100), 20), (2, 997, (1, 2), 5), (3, 64, (1, 1), 1), (1, 10, (0, 100), 20)])
def test_resampling_equals_brute_force(spark, docs, most, buckets, share, least):
    target = spark.createDataFrame([(1, prose(random.Random(9), 60)), (2, None), (3, "")], "item_id long, text string")
    got = importance_sampling.importance_resample(docs, target, buckets=buckets, most=most, share=share, least=least, seed=7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = resample_by_force(rows, [(1, r.text) for r in target.collect()], most, buckets, share, least, 7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_of_nothing(spark, docs, empty):
    assert importance_sampling.importance_resample(empty, docs).collect() == []
    assert importance_sampling.importance_resample(docs, empty, buckets=10).where("rank IS NOT NULL").count() > 0
    with pytest.raises(ValueError):
        importance_sampling.bucket_gains(docs, docs, buckets=importance_sampling.MOST_BUCKETS + 1)


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("x"), "id")
    got = importance_sampling.ranked(rows, [F.desc("x"), F.col("id")]).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 5001))
    assert [(r.x, r.id) for r in got] == sorted(((i % 7, i) for i in range(5000)), key=lambda v: (-v[0], v[1]))


def test_resampling_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    df = queries.op12_importance_resampling(spark, sf_dir)
    assert sorted((tuple(r) for r in df.collect()), key=str) == resample_by_force(docs, target, 1, 10_000, (10, 100), 20, 2024)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def runs_by_force(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _strings():
    rng = random.Random(1)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 150:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield from ([bin(i).count("1") % 2 for i in range(200)], fibonacci[-1], [1] * 50, [1, 2] * 30, [], list(range(40)))
    for _ in range(400):
        t = [rng.randrange(rng.choice([1, 2, 2, 3, 4])) for _ in range(rng.randrange(90))]
        if rng.random() < 0.5:
            t = t + t[: rng.randrange(1, 20)] * rng.randrange(1, 6) + t[: rng.randrange(30)]
        yield t


@pytest.mark.parametrize("least", [2, 3, 6, 12])
def test_runs_equal_brute_force(least, monkeypatch):
    monkeypatch.setattr(periodic_runs, "_PAIRS", 16)  # boundaries are cut by periods too
    strings = list(_strings())
    for lo in range(0, len(strings), 9):
        group = strings[lo : lo + 9]
        first = np.concatenate([[0], np.cumsum([len(t) for t in group])])
        runs = periodic_runs.runs_of(np.array([x for t in group for x in t], np.uint64), first, least)
        got = [[] for _ in group]
        for s, n, q in zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist(), strict=True):
            d = int(np.searchsorted(first, s, side="right")) - 1
            got[d].append((s - int(first[d]), n, q))
        assert got == [runs_by_force(t, least) for t in group]


def test_previous_factors_equal_brute_force():
    rng = random.Random(4)
    for _ in range(50):
        group = [[rng.randrange(2) for _ in range(rng.randrange(1, 40))] for _ in range(3)]
        first = np.concatenate([[0], np.cumsum([len(t) for t in group])])
        ext = periodic_runs.Extensions(np.array([x for t in group for x in t], np.uint64), np.repeat(np.arange(3), [len(t) for t in group]))
        lpf, source = ext.previous_factors()
        for d, t in enumerate(group):
            for i in range(len(t)):
                shared = [next((k for k in range(len(t) - i) if t[j + k] != t[i + k]), len(t) - i) for j in range(i)]
                assert lpf[first[d] + i] == max(shared, default=0)
                if lpf[first[d] + i]:
                    assert shared[source[first[d] + i] - first[d]] == lpf[first[d] + i]


def collapsed_by_force(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_run_rows_equal_brute_force(spark, docs, empty):
    odd = [(500, "a  b\ta\nb\x0ba b a b a b a b a b"), (501, " é " * 40), (502, "x y z " * 5 + "end"), (503, ("p q r s " * 3 + "t ") * 4), (504, "a\x00b " * 13)]
    df = docs.select("doc_id", "text", "lang", "id").unionByName(spark.createDataFrame([(i, t, "n", "runs") for i, t in odd], "doc_id long, text string, lang string, id string"))
    got = periodic_runs.periodic_runs(df, carry={"doc_id": F.col("doc_id"), "lang": F.col("lang")}).collect()
    expected = []
    for r in df.collect():
        w = words_of(r.text)
        runs = runs_by_force(w, 12) if len(w) < 2000 else [(0, len(w), 1)]
        expected.append((r.doc_id, r.lang, len(w), runs, collapsed_by_force(w, runs)))
    assert sorted(((r.doc_id, r.lang, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(expected, key=str)
    assert periodic_runs.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, least=1)


def planted_by_force(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_run_query_equals_brute_force(spark, sf_dir):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        w = planted_by_force(r.doc_id, r.text)
        if len(w) > 1500:
            continue
        runs = runs_by_force(w, 12)
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        expected[r.doc_id] = (len(runs), s, n, q, 1000 * n // q if runs else None, sha(lines), sha(collapsed_by_force(w, runs)))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert {i: got[i] for i in expected} == expected
    assert sum(v[0] > 0 for v in expected.values()) > 5
