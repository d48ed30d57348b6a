"""Mixing: overlapping sources, any column names, the flow's cost and speed against brute force."""

import collections
import itertools
import random
import time

import pytest

from atril.llm import mixing

CLASH = {"slice": "int", "whole": "string", "pattern": "string", "across": "int", "level": "int", "copies": "int", "ahead": "int", "total": "string", "rows": "int", "pattern_key": "string", "words": "int", "rest": "int", "words_left": "int", "text_key": "string"}


def cheapest(capacity, quota, copies=2):
    """Most words, then least cost, over all whole flows of a tiny network."""
    routes = [(p, s) for p in capacity for s in p]
    best = (0, 0)
    for took in itertools.product(*(range(copies * capacity[p] + 1) for p, _ in routes)):
        out, used = collections.Counter(), collections.Counter()
        for (p, s), n in zip(routes, took, strict=True):
            out[s] += n
            used[p] += n
        if all(out[s] <= q for s, q in quota.items()) and all(used[p] <= copies * n for p, n in capacity.items()):
            best = max(best, (sum(took), -sum(max(0, used[p] - n) for p, n in capacity.items())))
    return best


def test_flow_against_all_flows():
    rng = random.Random(8)
    for _ in range(60):
        patterns = rng.sample([("a",), ("b",), ("a", "b"), ("b", None), (None,)], 3)
        capacity = {p: rng.randint(1, 3) for p in patterns}
        quota = {s: rng.randint(0, 5) for s in {s for p in patterns for s in p}}
        routes = mixing.flow(capacity, quota)
        used = collections.Counter()
        for (p, _), n in routes.items():
            used[p] += n
        assert (sum(routes.values()), -sum(max(0, used[p] - n) for p, n in capacity.items())) == cheapest(capacity, quota)


def test_flow_of_many_patterns():
    rng, names = random.Random(9), [f"s{k}" for k in range(200)]
    capacity = {tuple(sorted(rng.sample(names, 3))): rng.randint(1, 10**6) for _ in range(5000)}
    sizes = collections.Counter()
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    began = time.time()
    routes = mixing.flow(capacity, {s: n // 2 for s, n in sizes.items()})
    assert time.time() - began < 30 and sum(routes.values()) > 0


def test_overlapping_sources(spark):
    rng = random.Random(10)
    rows = []
    for k in range(4000):
        members = rng.sample(["a", "b", "c", None], rng.choice([1, 1, 2, 3]))
        rows.append((k, rng.choice([0, 1, 5, 40, 300, 900]), [*members, members[0]], k % 7))
    rows += [(9000, 5, [], 0), (None, 3, ["a"], 0)]
    taken, plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, size long, members array<string>, other int"))
    got = taken.collect()
    assert len(got) == len(rows) and taken.columns == ["doc_id", "size", "members", "other", "copies"]
    used, sums = collections.Counter(), collections.Counter()
    for r in got:
        pattern = tuple(sorted(set(r.members), key=lambda s: (s is None, s or "")))
        used[pattern] += r.copies * r["size"]
        sums[pattern] += r["size"]
        assert r.copies in (0, 1, 2) and (r["size"] or not r.copies)
    wanted = collections.Counter()
    for (p, _), n in plan.routes.items():
        wanted[p] += n
    assert all(abs(used[p] - wanted[p]) <= 450 for p in sums)
    for s, goal in plan.targets.items():
        got_words = sum(n for (_, x), n in plan.routes.items() if x == s)
        assert abs(got_words - goal) <= 1 or got_words < goal and all(wanted[p] == 2 * n for p, n in sums.items() if s in p)
    assert sorted(map(repr, mixing.mix(spark.createDataFrame(rows, "doc_id long, size long, members array<string>, other int"))[0].collect())) == sorted(map(repr, got))


@pytest.fixture
def clashing(spark):
    rows = [(k, " ".join(["w"] * (k % 60)), "ab"[k % 2], *([1] * len(CLASH))) for k in range(200)] + [(5, None, None, *([2] * len(CLASH)))]
    fields = ", ".join(f"`{n}` {t}" for n, t in CLASH.items())
    return spark.createDataFrame([tuple(str(v) if j > 2 and list(CLASH.values())[j - 3] == "string" else v for j, v in enumerate(r)) for r in rows], f"doc_id long, text string, source string, {fields}")


def test_columns_of_any_name(spark, clashing):
    rows = clashing.selectExpr("*", "array(source) as members", "size(split(text, ' ')) as size")
    taken, _ = mixing.mix(rows)
    assert taken.count() == 201 and sorted(taken.columns) == sorted(rows.columns) and taken.where("copies > 0").count() > 0
    staged = mixing.stage(spark, clashing, "")
    assert staged.columns == clashing.columns and staged.count() > 200
