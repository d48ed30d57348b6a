"""Facts of many pairs at once are those of each pair."""

import random
import time

from atril.functions import batch, scoring


def pairs(n: int, longest: int = 30, seed: int = 1) -> tuple[list, list, list]:
    rng = random.Random(seed)
    words = [*"abcdefg", "de", "la"]
    refs = [[rng.choice(words) for _ in range(rng.randint(0, longest))] for _ in range(n)]
    hyps = [[x for w in r for x in rng.choice([[w], [w], [w], [], [w, w], ["z"], [rng.choice(words)]])] + [rng.choice(words)] * rng.choice([0, 0, 5]) for r in refs]
    golds = [tuple(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([0, 1, 3]))) for _ in refs]
    return refs, hyps, golds


def test_all_facts():
    refs, hyps, golds = pairs(4000)
    refs += [["w"] * 70, ["a", "b"] * 40, []]
    hyps += [["w"] * 90, ["a", "b"] * 33, ["x"] * 64]
    golds += [("w w",), (), ("x",)]
    for got, *pair in zip(batch.facts_of(refs, hyps, golds, False), refs, hyps, golds, strict=True):
        assert got == scoring.facts(*pair, False)


def test_no_loop_is_passed_over():
    refs, hyps, _ = pairs(3000, 60, 2)
    hyps = [h[:60] for h in hyps] + [list("abcdeabcdex"), list("abababx"), list("aaaa"), list("aaa")]
    for may, h in zip(batch.may_loop(hyps), hyps, strict=True):
        assert may or not (scoring.loops(h) or scoring.repeat_rate(h))


def test_nothing():
    assert batch.facts_of([], [], []) == []


def test_fast():
    refs, hyps, golds = pairs(20_000, 24)
    began = time.time()
    batch.facts_of(refs, hyps, golds, False)
    assert time.time() - began < 6
