"""Training-data operators on rows that once were cut, wrapped or lost."""

import collections

import pytest

from atril.llm import bpe, html_text, mixing


def test_bpe_words_of_many_tokens(spark):
    texts = ["short text", "".join(chr(0x3042 + k % 83) for k in range(40_005)), "after it", "1,2,x\n" * 12_000]
    t = bpe.tokenizer(bpe.VOCABULARY)
    want = {k: t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts)}
    assert max(map(len, want.values())) > 65_535
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert got == {k: (want[k], x) for k, x in enumerate(texts)}


LONG = " ".join(["word"] * 40)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><meta x><body><article><p>{LONG}</p></article>",
        f"<head><title>t</title><article><p>{LONG}</p></article>",
        f"<head><link rel=x>\n{LONG}",
        *(f"<div class='{c}'><article><p>{LONG}</p></article></div>" for c in ("has-sidebar", "no-sidebar", "content-sidebar-wrap")),
        f"<nav><a href=/>x</a><button>Open<article><p>{LONG}</p></article>",
    ],
)
def test_articles_are_not_lost(page):
    assert html_text.extract(page, html_text.train()).split("\n")[-1] == LONG


def test_articles_do_not_undo_navigation():
    text = f"<main><p>{LONG}</p><nav class=menu><article><p>a</p></article></nav><aside><article>teaser</article></aside><div hidden><article>off</article></div><article><div class=comments><p>nice</p></div></article></main>"
    found = {b[0]: b[3] for b in html_text.blocks(text)}
    assert found[LONG] == 1 and found["teaser"] == found["off"] == found["nice"] == -1


def test_mixing_stage_on_repeated_rows(spark):
    rows = [(1, "one two three", "a")] * 5 + [(1, "other words here", "a"), (None, "no id", None), (None, "no id", None)] + [(k, f"text number {k}", "b") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = collections.Counter()
    for r in mixing.mix(mixing._sized(docs))[0].collect():
        want[r.doc_id, r.source, r.text_hash] += r.copies
    got = collections.Counter(tuple(r) for r in mixing.stage(spark, docs, "").selectExpr("doc_id", "source", "xxhash64(text)").collect())
    assert got == +want and max(want.values()) > 2
