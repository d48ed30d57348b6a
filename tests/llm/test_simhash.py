"""SimHash: links against all pairs in whole and in split groups, fingerprints of odd and long texts, any column names."""

import random

import numpy as np
import pytest
import xxhash

from atril.llm import graph, simhash


@pytest.mark.parametrize("group", [2, 64, simhash.GROUP])
def test_links_against_all_pairs(spark, group):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    walks = [base]
    for _ in range(6):
        step = np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) | np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
        walks.append(walks[-1] ^ step)
    dense = base[0] ^ np.array([1 << a | 1 << b for a in range(20) for b in range(a)], np.uint64)
    fps = np.unique(np.concatenate([*walks, dense, np.array([0, 1, 3, 7, 2**64 - 1], np.uint64)]))
    signed = fps.view(np.int64)
    made = simhash.links(spark.createDataFrame([(int(x),) for x in signed], "fp long"), group).collect()
    assert all((r.a ^ r.b) & (2**64 - 1) and ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in made)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(made, "a long, b long")).collect()}
    label = dict(zip(signed.tolist(), signed.tolist(), strict=True))
    for _ in range(len(fps)):
        new = {int(x): min(label[int(y)] for y in signed[np.bitwise_count(fps ^ fps[k]) <= 2]) for k, x in enumerate(signed)}
        if new == label:
            break
        label = new
    assert all(got.get(x, x) == root for x, root in label.items())


def brute(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    words = [w for w in words if w]
    grams = [words[k : k + 3] for k in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_odd_and_long_texts():
    rng = random.Random(3)
    parts = ["Ab", "é", "\x0b", " ", "\t", " ", "\x1c", "x1", "Zz ", "\n", "Σ"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert simhash.fingerprint(text.encode()) == brute(text)
    long = " ".join(rng.choice(["one", "two", "three", "four"]) + str(rng.randint(0, 9)) for _ in range(400_000))
    assert len(long) > 2 << 20 and simhash.fingerprint(long.encode()) == brute(long)
    assert simhash.fingerprint(b"x" * (3 << 20)) == brute("x" * (3 << 20))


def test_any_column_names(spark):
    names = ["fp", "root", "component_id", "text_key", "copies", "stay_id", "none", "first", "n"]
    rows = [(k, f"some words that are number {k // 2} of many " * 5, *([k] * len(names))) for k in range(12)] + [(None, None, *([0] * len(names)))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    assert simhash.near_duplicates(docs).count() == 14
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, k) for k in range(0, 12, 2)] + [(True, None)]
