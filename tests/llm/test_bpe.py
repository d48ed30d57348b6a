"""BPE: the distinct-word table, ids and texts against the library, odd rows."""

import hashlib
import random
import struct

from atril.llm import bpe

PARTS = ["word", "Ñandú", " ", " ", "  ", "\n", "\t", "日本語", "<|endoftext|>", "it's", "12,5", "a" * 40, "\x1c", "\xa0", "🙂", "'"]


def texts(n=150):
    rng = random.Random(4)
    return [None, "", " ", "  \n ", "x" * 70_000, "y " * 20_000, *("".join(rng.choice(PARTS) for _ in range(rng.choice([1, 5, 60, 900]))) for _ in range(n))]


def test_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 20_000)
    t, rows = bpe.tokenizer(bpe.VOCABULARY), list(enumerate(texts()))
    rows += [rows[9], rows[9], (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash", [1]) for r in rows], "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    want = sorted(((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, x in rows for ids in [t.encode(x or "", add_special_tokens=False).ids]), key=repr)
    assert sorted(map(tuple, bpe.run(docs).collect()), key=repr) == want
    whole = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in whole) == sorted((i or -1, x or "") for i, x in rows)


def test_each_distinct_word_once(spark):
    t, said = bpe.tokenizer(bpe.VOCABULARY), texts(40)
    words, answers = bpe.word_table(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(4))
    got = {bytes(r.word): r.ids for r in words.collect()}
    want = set()
    for x in said:
        first, *rest = bpe.split(x or "")
        want |= {w.encode() for w in [first, *(" " + w for w in rest)]} if x else set()
    assert words.count() == len(got) and set(got) == want and answers.count() > 0
    assert all(ids == t.encode(w.decode(), add_special_tokens=False).ids for w, ids in got.items())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.run(none).count() == 0 and bpe.word_table(none)[0].count() == 0
