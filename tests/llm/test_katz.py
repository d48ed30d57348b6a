"""Katz backoff against a model of plain dictionaries, which sums to one over all words at every history."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from atril.llm import common, katz

SCHEMA = "doc_id long, text string, score int, tokens string"
END = "</s>"


class Plain:
    """Recursive Katz probabilities from counters; Good-Turing by a least-squares line through log n_r."""

    def __init__(self, texts: list[list[str]], order: int):
        self.order, self.grams = order, {n: collections.Counter() for n in range(1, order + 1)}
        for words in texts:
            line = [None] * (order - 1) + words + [END]
            for k in range(order - 1, len(line)):
                for n in self.grams:
                    self.grams[n][tuple(line[k - n + 1 : k + 1])] += 1
        self.tokens = sum(self.grams[1].values())
        self.after = {n: collections.defaultdict(dict) for n in range(2, order + 1)}
        for n, after in self.after.items():
            for g, c in self.grams[n].items():
                after[g[:-1]][g[-1]] = c
        self.factor = {n: self.factors(collections.Counter(c.values())) for n, c in self.grams.items()}
        freed = sum(c - self.kept(1, c) for c in self.grams[1].values())
        self.total1, self.unknown = (self.tokens, freed / self.tokens) if freed > 0 else (self.tokens + 1, 1 / (self.tokens + 1))

    @staticmethod
    def factors(n):
        points = [(math.log(r), math.log(n[r])) for r in range(1, 7) if n[r]]
        b = -2.0
        if len(points) > 1:
            mx, my = (sum(p[k] for p in points) / len(points) for k in (0, 1))
            b = min(-1.05, sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points))
        expected = lambda r: r**b
        cut = 6 * expected(6) / expected(1)
        return {r: ((r + 1) * expected(r + 1) / (r * expected(r)) - cut) / (1 - cut) for r in range(1, 6)}

    def kept(self, n, c):
        return c * self.factor[n].get(c, 1.0)

    def p(self, history: tuple, word: str) -> float:
        n = len(history) + 1
        if n == 1:
            c = self.grams[1][word,]
            return self.kept(1, c) / self.total1 if c else self.unknown
        after = self.after[n].get(history)
        if not after:
            return self.p(history[1:], word)
        total, kept = sum(after.values()), sum(self.kept(n, c) for c in after.values())
        total += kept >= total * (1 - 1e-12)
        if word in after:
            return self.kept(n, after[word]) / total
        return self.backoff(history) * self.p(history[1:], word)

    def backoff(self, history):
        n, after = len(history) + 1, self.after[len(history) + 1][history]
        total, kept = sum(after.values()), sum(self.kept(n, c) for c in after.values())
        total += kept >= total * (1 - 1e-12)
        return (1 - kept / total) / (1 - sum(self.p(history[1:], w) for w in after))

    def score(self, words):
        line = [None] * (self.order - 1) + words + [END]
        return sum(math.log10(self.p(tuple(line[k - self.order + 1 : k]), line[k])) for k in range(self.order - 1, len(line)))


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    words = ["The", "a", "the", *"bcdefgh", "é", "rare\x1cword"]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 6, 12])]) + rng.choice(["", "", "", "\n"]) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)]
    texts += [None, "", " \t", "a " * 2000, "once only", "x" * 5000]
    rows = [(k, t, 1, "clash") for k, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, "a b", 1, None)]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def split(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lowered.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]


@pytest.mark.parametrize(("order", "hot", "rounds"), [(1, 1000, 1), (2, 8, 2), (3, 1000, 1), (3, 8, 3), (4, 20, 1)])
def test_scores(spark, monkeypatch, order, hot, rounds):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "ROUNDS", rounds)
    monkeypatch.setattr(katz, "ROUND_BYTES", 1)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain = Plain([split(t) for i, t, *_ in rows if not held(i)], order)
    model, scored = katz.fit_and_score(docs, order)
    want = collections.Counter()
    for i, t, *_ in rows:
        words = split(t)
        known = sum(plain.grams[1][w,] > 0 for w in [*words, END])
        base = sum(math.log10((plain.grams[1][w,] + 0.1) / (plain.tokens + 0.1 * (len(plain.grams[1]) + 1))) for w in [*words, END])
        want[i, held(i), len(words) + 1, known, plain.tokens, round(base, 6), round(plain.score(words), 6)] += 1
    got = lambda df: collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())
    assert got(scored) == want
    assert order == 1 or any(model.shared.values())
    if order == 3:
        assert got(katz.score(docs.repartition(5), model)) == want
        other = spark.createDataFrame([(1, "a b quite unseen words the a", 0, ""), (2, None, 0, "")], SCHEMA)
        assert {r.doc_id: round(r.score, 6) for r in katz.score(other, model).collect()} == {1: round(plain.score(split("a b quite unseen words the a")), 6), 2: round(plain.score([]), 6)}


def test_tables_and_sums_to_one(spark, monkeypatch):
    monkeypatch.setattr(katz, "ROUNDS", 2)
    monkeypatch.setattr(katz, "ROUND_BYTES", 1)
    rows = corpus(40, 9)
    texts = [split(t) for i, t, *_ in rows if not held(i)]
    plain, model = Plain(texts, 3), katz.fit(spark.createDataFrame(rows, SCHEMA), 3)
    words = model.words().collect()
    assert sorted(r["count"] for r in words) == sorted(plain.grams[1].values()) and sum(r.probability for r in words) + model.unigrams.unknown == pytest.approx(1)
    one = {r.id: r.probability for r in words}
    p = {(): one}
    for n in (2, 3):
        table, weights = model.table(n).collect(), {tuple(r.history): r.backoff for r in model.backoffs(n).collect()}
        assert sorted((r["count"], round(r.probability, 9)) for r in table) == sorted((c, round(plain.p(g[:-1], g[-1]), 9)) for g, c in plain.grams[n].items())
        assert sorted(round(b, 9) for b in weights.values()) == sorted(round(plain.backoff(h), 9) for h in plain.after[n])
        seen = collections.defaultdict(dict)
        for r in table:
            seen[tuple(r.history)][r.word] = r.probability
        for h, after in seen.items():
            below = p.get(h[1:], one)
            p[h] = {w: after[w] if w in after else weights[h] * below[w] for w in one}
            low = model.unigrams.unknown if n == 2 else p_unknown[h[1:]]
            assert sum(p[h].values()) + weights[h] * low == pytest.approx(1)
        p_unknown = {h: weights[h] * model.unigrams.unknown for h in seen} if n == 2 else {}
    vocabulary = [*(w for (w,) in plain.grams[1]), "never seen"]
    for h in [*list(plain.after[3])[:20], ("never", "seen"), (None, None), ("never", "a")]:
        assert sum(plain.p(h, w) for w in vocabulary) == pytest.approx(1)


def test_discounts():
    for n in ([0, 100, 40, 20, 12, 8, 6], [0, 5, 0, 0, 0, 0, 0], [0] * 7, [0, 3, 9, 30, 50, 80, 99], [0, 1, 0, 4, 0, 0, 0], [0, 10**9, 2, 1, 1, 1, 1]):
        d = katz.discounts(np.array(n, float))
        assert d[0] == 0 and (d[1:] > 0).all() and (d[1:] < 1).all() and (np.diff(d[1:]) > 0).all()


def test_nothing_to_learn_from(spark):
    assert katz.fit_and_score(spark.createDataFrame([], SCHEMA))[1].count() == 0
    only = next(k for k in range(100) if held(k))
    rows = katz.fit_and_score(spark.createDataFrame([(only, "a b", 0, ""), (only, None, 0, "")], SCHEMA))[1].collect()
    assert len(rows) == 2 and all((r.score, r.train_tokens, r.n_known) == (0.0, 0, 0) for r in rows)


def test_many_columns_of_large_ids():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 1 << 40, 500) for _ in range(3)]
    cols = [np.concatenate([c, c[:100]]) for c in cols]
    first, inverse = katz._distinct(cols)
    rows = [tuple(int(c[k]) for c in cols) for k in range(600)]
    assert [rows[k] for k in first] == sorted(set(rows)) and [rows[first[j]] for j in inverse] == rows
    assert all((a == b).all() for a, b in zip(katz._unpacked(katz._packed(cols)), cols, strict=True))


def test_counts_need_no_higher_level(spark, tmp_path, monkeypatch):
    """The columns of llm_training_counts are those of the whole model, from the words' level alone."""
    from atril.llm import queries

    rows = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k % 40))) for k in range(60)] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    want = {(*r[:5], round(r.base_score, 4)) for r in katz.query(spark, str(tmp_path)).select(*names, "base_score").collect()}
    monkeypatch.setattr(katz, "_asks", None)
    assert set(map(tuple, queries.llm_training_counts(spark, str(tmp_path)).collect())) == want


def test_keys_and_places_sort_as_one_number():
    """Where both fit in a number; keys with more bits are sorted apart, alike."""
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 5000):
        for bits in (1, 12, 40, 60, 63):
            key = rng.integers(0, 1 << min(bits, 12), size) << max(bits - 12, 0)
            keys, first, inverse = katz.distinct(key, bits)
            assert (keys == np.unique(key)).all() and (key[first] == keys).all() and (keys[inverse] == key).all()
            _, order = katz.ranked(key, bits)
            assert (np.sort(order) == np.arange(size)).all() and (np.diff(key[order]) >= 0).all()


def test_words_are_numbered_as_bytes_split():
    """Also next to white space that is not ASCII's, in bytes that are no UTF-8, and in texts without words."""
    rng = random.Random(8)
    kinds = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x1f", b"\x85", b"\x00", b"a", b"b", "\u00e9".encode(), "\u2028".encode(), b"\xff"]
    texts = [b"", b" \n", b"a", *(b"".join(rng.choices(kinds, k=rng.randint(0, 40))) for _ in range(2000))]
    for some in (texts, [b""], [b" "], [b"x" * 70_000 + b" y"]):
        sizes, found, words = common.numbered(some)
        want = [common.words_of(t) for t in some]
        assert sizes.tolist() == list(map(len, want)) and [words[k] for k in found] == [w for t in want for w in t]
        assert words == list(dict.fromkeys(w for t in want for w in t))
