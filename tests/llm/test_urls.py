"""URL filters: suffix statistics, CASE against the fitted model, verdicts on labelled URLs, odd rows."""

import math
import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler

from atril.llm import urls

SCHEMA = "page_id long, url string"


def labelled(spark, rows):
    return urls.ruled(spark.createDataFrame(rows, SCHEMA)).where("rule is not null").groupBy("url", "host", "path").agg({"said": "first"}).withColumnRenamed("first(said)", "said")


def test_suffix_statistics_are_of_all_urls(spark):
    rows = [(k, f"http://h{k}.{'com' if k % 3 else 'net'}/{'' if k % 3 else 'es/'}p{k}.{'rare' if k % 50 == 0 else 'html'}") for k in range(600)]
    stats = urls.suffixes(labelled(spark, rows + rows[:100]))
    assert (stats.n, stats.blocked) == (600, 200)
    path = {r[0]: (r.n, r.blocked) for r in stats.tables["path_suffix"].collect()}
    host = {r[0]: (r.n, r.blocked) for r in stats.tables["host_suffix"].collect()}
    assert path == {"rare": (12, 4), "html": (588, 196)} and host == {"com": (400, 0), "net": (200, 200)}
    seen = urls.with_suffixes(urls.lexical(urls.ruled(spark.createDataFrame([(1, "http://x.net/q.rare"), (2, "http://x.org/q")], SCHEMA))), stats).orderBy("page_id").collect()
    assert seen[0].host_suffix_share == pytest.approx(1 / 3) and seen[0].host_suffix_blocked == pytest.approx((200 + 10 / 3) / 210) and seen[0].path_suffix_blocked == pytest.approx((4 + 10 / 3) / 22)
    assert seen[1].host_suffix_share == seen[1].path_suffix_share == 0 and seen[1].host_suffix_blocked == pytest.approx(1 / 3)


def test_suffixes_outside_the_sample_count(spark, monkeypatch):
    seen, real = [], urls.with_suffixes
    monkeypatch.setattr(urls, "with_suffixes", lambda rows, stats, *a: seen.append({r.path_suffix: r.n for r in stats.tables["path_suffix"].collect()}) or real(rows, stats, *a))
    rows = [(k, f"http://h{k}.{'com' if k % 2 else 'net'}/es/p.s{k}") for k in range(60)]
    pages = spark.createDataFrame([*rows, (99, "http://h.org/x.s1")], SCHEMA)
    assert urls.judge(pages, max_labelled=30).count() == 61 and seen == [{f"s{k}": 1 for k in range(60)}] * 2
    monkeypatch.setattr(urls, "MAX_BROADCAST", 5)
    assert urls.judge(pages, max_labelled=30).count() == 61


def features(url):
    host = url.split("://")[1].split("/")[0]
    n = len(url)
    return {
        "length": n, "host_length": len(host), "labels": host.count("."), "depth": url.split("://")[1].split("?")[0].count("/"), "digit_ratio": sum(c.isdigit() for c in url) / n, "hyphens": host.count("-"),
        "entropy": -sum(url.count(c) / n * math.log2(url.count(c) / n) for c in set(url)), "parameters": url.count("&") + ("?" in url), "has_fragment": float("#" in url), "host_suffix_length": len(host.rsplit(".", 1)[-1]),
    }


def made(rng, suffix, bad):
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    if bad:
        return f"http://{word(4)}-{rng.randint(100, 999)}-{word(5)}.{suffix}/{'es/' if suffix == 'net' else ''}{rng.randint(10**8, 10**9)}/{word(9)}?a={rng.randint(1, 9999)}&b={word(6)}&c={rng.randint(1, 9)}"
    return f"http://{word(6)}.{suffix}/{word(5)}.html"


def test_lexical_features_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, made(rng, "org", k % 2)) for k in range(60)] + [(60, "http://h.org/a#b")]
    for r in urls.lexical(urls.ruled(spark.createDataFrame(rows, SCHEMA))).collect():
        want = features(r.url)
        assert all(r[k] == pytest.approx(v) for k, v in want.items()), r.url


def test_case_is_the_fitted_model(spark):
    rng = random.Random(2)
    rows = [(k, made(rng, "com" if k % 2 else "net", k % 2 == 0)) for k in range(200)]
    known = labelled(spark, rows)
    table = urls.with_suffixes(urls.lexical(known), urls.suffixes(known)).selectExpr("*", "double(said = 'block' and length > 60) as label")
    learn = VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(table)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(learn)
    for r in model.transform(learn).withColumn("margin", urls.margin(model)).collect():
        assert (r.margin > 0) == (r.prediction == 1) and 2 * r.margin == pytest.approx(r.rawPrediction[1], abs=1e-9) or r.margin == pytest.approx(r.rawPrediction[1], abs=1e-9)


def test_verdicts_on_labelled_urls(spark):
    rng = random.Random(3)
    rows = [(k, made(rng, "net" if k % 2 else "com", k % 2)) for k in range(600)]
    truth = {1000 + k: k % 2 for k in range(200)}
    rows += [(k, made(rng, "org", bad)) for k, bad in truth.items()]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = sum((got[k].verdict == "block") == bool(bad) for k, bad in truth.items())
    assert right >= 190 and all(got[k].rule is None for k in truth)


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "no scheme"), (3, "http://h.org/" + "a1" * 200_000), (4, "http://h.org/x"), (4, "http://h.org/x"), (5, "ftp://a.COM?x"), (6, "://"), (7, "http://x.net/es/#1")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", host string, rule int")
    got = urls.judge(frame).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and len({r.verdict for r in got if r.page_id == 4}) == 1 and by[5].host == "a.com" and by[5].rule is None and by[3].path == "/" + "a1" * 200_000 and by[7].rule == "net/es/"
