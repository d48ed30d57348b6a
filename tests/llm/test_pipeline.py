"""The pipeline on a small fixture: its first two stages and its ids against brute force, its mix against the targets."""

import collections
import hashlib
import random
import re
import struct

import pytest
import xxhash

import corpus_pipeline
from atril.llm import bpe, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int"


def documents() -> list[tuple]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.randint(40, 400)) for _ in range(50)] + [text(1500)]
    texts += [t.replace(" ", "  ", 3) for t in texts[:6]] + [t + " " + rng.choice(words) for t in texts[50:] * 3] + [texts[7].upper().lower(), texts[8]]
    texts += [None, "", "one", " \n ", "spam eggs ham " * 60, text(60) + " <|endoftext|>  tail"]
    rows = [(k + 10, t, "xx", rng.choice(["a", "b", None]), len(t or ""), 1) for k, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, text(80), "xx", "a", 1, 1), (1, None, None, None, None, None)]


def base_failed(text: str | None) -> bool:
    words = WORD.findall(text or "")
    count = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if count[w] > 1 for j in range(3)}
    return len(words) < 50 or 100 * len(again) > 50 * len(words)


def fingerprint(text: str) -> int:
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(len(words) - 2)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture
def folder(spark, tmp_path):
    def written(rows: list[tuple]) -> str:
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(10, 1), (11, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return written


def test_stages(spark, folder):
    rows, sf_dir = documents(), folder(documents())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (_, rules), (_, near), (_, mixed), (_, ids) = corpus_pipeline.STAGES
    order = lambda rows: sorted(map(tuple, rows), key=repr)

    kept = rules(spark, docs, sf_dir)
    want = [r for r in rows if not base_failed(r[1])]
    assert kept.columns == docs.columns and order(kept.collect()) == order(want) and len(want) < len(rows)

    fps = [fingerprint(r[1]) for r in want]
    group = list(range(len(want)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    members = collections.defaultdict(list)
    for g, r in zip(group, want, strict=True):
        members[g].append(r)
    first = [min(m, key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values()]
    single = near(spark, spark.createDataFrame(want, SCHEMA), sf_dir)
    assert single.columns == docs.columns and order(single.collect()) == order(first) and len(first) < len(want) - 8

    mix = mixed(spark, spark.createDataFrame(first, SCHEMA), sf_dir)
    got = [tuple(r) for r in mix.collect()]
    times = collections.Counter(got)
    size = {r: len(WORD.findall(r[1])) for r in first}
    sizes = collections.Counter()
    for r, n in size.items():
        sizes[r[3]] += n
    assert mix.columns == docs.columns and set(times) <= set(first) and max(times.values()) <= 2
    for source, goal in mixing.targets(dict(sizes)).items():
        assert abs(sum(n * size[r] for r, n in times.items() if r[3] == source) - goal) <= max(size.values()) / 2

    t = bpe.tokenizer(bpe.VOCABULARY)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in ids(spark, spark.createDataFrame(got, SCHEMA), sf_dir).join(docs.dropDuplicates(["doc_id"]), "doc_id").collect():
        encoded = t.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(encoded), sha(struct.pack(f"<{len(encoded)}I", *encoded)), sha(t.decode(encoded, skip_special_tokens=False).encode()))


def test_run_is_the_stages_in_turn_and_reruns_agree(spark, folder):
    sf_dir = folder(documents())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    got = sorted(map(tuple, docs.collect()), key=repr)
    assert len(got) > 40 and sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=repr) == got


def test_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_with_a_fitted_forest_and_clashing_names(spark, tmp_path):
    rng = random.Random(8)
    say = lambda words: " ".join(rng.choice(words) + str(rng.randint(0, 60)) for _ in range(150))
    good, bad = "the house by a river was old,".split(), "BUY now!!! $$$ ### click".split()
    names = ["score", "kept", "fp", "root", "copies", "size", "text_hash", "place", "total", "ids"]
    rows = [(k, say(bad if k % 2 else good), "xx", f"s{k % 3}", 1, *([k] * len(names))) for k in range(160)]
    rows += [(k + 500, rows[k][1].upper().lower(), *rows[k][2:]) for k in range(0, 20, 2)]
    fields = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` int" for n in names)
    spark.createDataFrame(rows, fields).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1 - k % 2) for k in range(100)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, rules), (_, near), (_, mixed), _ = corpus_pipeline.STAGES
    kept = rules(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len(ids & set(range(1, 160, 2))) <= 2 and len(ids & set(range(0, 160, 2))) >= 78
    single = near(spark, kept, str(tmp_path))
    left = {r.doc_id for r in single.collect()}
    assert single.columns == docs.columns and left == {i for i in ids if i < 500 or i - 500 not in ids}
    assert mixed(spark, single, str(tmp_path)).columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= left and len(out) >= len(left)
