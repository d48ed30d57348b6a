"""Operators against brute force, with nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest

from atril.llm import bpe, edits, graph, html_text, media, mixing, quality, simhash, trees, urls, warc
from atril.llm.common import scratch

SCHEMA = "doc_id long, text string, source string"
ODD = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "x " * 70, "b"), (4, "x " * 70, "b"), (None, "solo", "b"), (5, "The CAT sat on a mat. " * 30, "c"), (6, "the cat SAT on a mat. " * 30, "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == 0 and by[1].component_id == 1 and by[6].component_id == 5 and by[4].component_id == 4
    assert by[None].component_id is None
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_every_pair_within_two_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(3)), *(base ^ np.uint64(3 << k) for k in (0, 30, 62))])
    fps = np.unique(near)
    found = graph.components(simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")))
    got = {r.node: r.root for r in found.collect()}
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= 2]:
            a, b = root(int(x.view(np.int64))), root(int(y.view(np.int64)))
            parent[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == root(x) for x in parent)


def test_bpe(odd, none):
    t = bpe.tokenizer(bpe.VOCABULARY)
    got = bpe.decode(bpe.encode(odd)).collect()
    assert sorted((r.ids, r.decoded) for r in got) == sorted((t.encode(x or "", add_special_tokens=False).ids, x or "") for _, x, _ in ODD)
    assert bpe.run(none).count() == 0


def test_bpe_words_are_independent():
    t, rng = bpe.tokenizer(bpe.VOCABULARY), random.Random(2)
    parts = ["a", "b ", "  ", "\n", "\t", " ", "é", "<|endoftext|>", "'s", "'ll", "12", "!?", " ", "　", "\x1c", "\x85", "日本"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        first, *rest = bpe.split(x)
        words = [first, *(" " + w for w in rest)] if x else []
        assert [i for w in words for i in t.encode(w, add_special_tokens=False).ids] == t.encode(x, add_special_tokens=False).ids


def test_edits():
    count, encoding, rng = edits.counts(edits.VOCABULARY), edits.encoding(edits.VOCABULARY), random.Random(3)
    parts = ["a", "b ", "  ", "\n", " ", "'s", "'", "ll", "12", "!?", "word ", "the "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 40, 900])))
        tree = edits.Tree(text, count)
        for _ in range(5):
            at, drop, put = rng.randint(0, len(text) + 2), rng.choice([0, 1, 3, 50]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 300])))
            tree.edit(at, drop, put)
            at = min(at, len(text))
            text = text[:at] + put + text[at + min(drop, len(text) - at) :]
            assert tree.whole() == text and tree.total() == len(encoding.encode_ordinary(text))


def test_mixing(odd, none):
    taken, plan = mixing.mix(mixing._sized(odd))
    rows = taken.collect()
    assert len(rows) == len(ODD) and all(0 <= r.copies <= 2 for r in rows)
    assert list(mixing.targets({"a": 100, "b": 100, None: 100}).items()) == [("a", 200.0), ("b", 250 / 3), (None, 500 / 3)]
    assert mixing.mix(mixing._sized(none))[0].count() == 0


def test_mixing_never_leaves_sources_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    wordless = spark.createDataFrame([(k, "some words" if k < 2 else "", f"s{k}") for k in range(5)], SCHEMA)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(mixing._sized(wordless))


def test_flow_is_cheapest():
    routes = mixing.flow({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 15, "b": 12})
    assert routes[("a",), "a"] + routes[("a", "b"), "a"] == 15
    used = collections.Counter()
    for (pattern, _), n in routes.items():
        used[pattern] += n
    assert sum(used.values()) == 27 and sum(max(0, used[p] - n) for p, n in ((("a",), 10), (("a", "b"), 10), (("b",), 5))) == 2


def test_quality(spark, odd, none):
    clash = odd.selectExpr("*", "1 as n_words", "'x' as KEPT")
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (6, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert quality.train(odd, labels) is not None and quality.train(none, labels) is None
    rows = quality.judge(odd, None).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[4].base_failed and by[4].n_repeat_words == 70 and not by[1].kept and by[1].n_words == 0
    assert quality.judge(clash, None, {"n_words": "n1", "kept": "k1"}).columns[:5] == clash.columns


def test_trees_keep_their_direction():
    rng = np.random.default_rng(4)
    x = rng.random((400, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(400) < 0.2)).astype(float)
    forest = trees.fit(x, y, monotone=(-1, 0))
    line = np.stack([np.linspace(0, 1, 101), np.full(101, 0.3)], 1)
    assert (np.diff(forest.margin(line)) <= 1e-12).all() and ((forest.probability(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.9


def test_media(odd, none):
    for n in (0, 1, 191, 192, 193, 192 * 64, 192 * 65 + 5):
        payload = media.padded(b"q" * n)
        info = media.demux(stored := media.mux(payload))
        assert media.payload_of(stored, info) == payload and info["codec"] == "raw " and info["samples"] == len(payload) // 192
        assert all(stored[info["offset"][k] : info["offset"][k] + 192] == payload[192 * k : 192 * k + 192] for k in info["keyframes"])
    assert media.demux(b"\x00\x00\x00\x08ftyp")["codec"] is None
    rows = media.describe(media.store(odd)).collect()
    assert len(rows) == len(ODD) and media.describe(media.store(none)).count() == 0
    assert {r.payload_sha256 for r in rows if r.doc_id in (1, 2)} == {hashlib.sha256(b" " * 192).hexdigest()}


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "u", None), (5, "u", None), (None, "n", big)]
    folder = scratch(spark, "warc-test")
    index = warc.write(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), folder)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(index, folder).collect()}
    assert got == {(1, "revisit", 2, 1200), (2, "response", None, 1200), (None, "revisit", 2, 1200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0)}
    assert warc.read(index.where("page_id = 3"), folder).first().payload == b"small"
    assert [(f, a, b, len(m)) for f, a, b, m in warc.ranges([("x", 0, 5), ("x", 5, 5), ("x", 1 << 20, 5), ("y", 0, 1)])] == [("x", 0, 10, 2), ("x", 1 << 20, (1 << 20) + 5, 1), ("y", 0, 1, 1)]


def test_html():
    tree = html_text.train()
    page = "<title>t</title><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use</div><main><h1>A &amp; b</h1><p>One  two <a href=x>link</a>.<ul><li>a<li>b</ul><aside>no</aside><form>f</form><div id=comments><p>nice</div><script>x='</p>'</script><p>Bye.</main><footer>f</footer>"
    assert html_text.extract(page, tree) == "A & b\nOne two link.\na\nb\nBye."
    assert html_text.extract(None, tree) == "" and html_text.extract("<<p <!-- x", tree) == html_text.extract("<<p <!-- x", tree)
    long = " ".join(["word"] * 40)
    assert html_text.extract(f"<ul><li><a href=/>x</a></ul><p>{long}</p><p>{long}</p>", tree) == f"{long}\n{long}"


def test_urls(spark):
    rows = [(1, "http://A.com/x"), (2, "https://www.Example.com/en/1?x"), (3, "http://b.example.com/en/"), (4, "http://x.net/es/1"), (5, "http://x.org/a1.html?p=1&q=2"), (6, None), (7, "nothing"), (8, "http://y.net/fr/"), (9, "http://notcom/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[k].rule for k in range(1, 10)] == ["com/", "www.example.com/en/", "example.com/en/", "net/es/", None, None, None, "net/fr/", None]
    assert [got[k].verdict for k in (1, 2, 3, 4, 8)] == ["allow", "allow", "block", "block", "block"] and all(r.verdict in ("allow", "block") for r in got.values())
    assert got[6].host == got[7].path == "" and got[5].path == "/a1.html"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
