"""Clips that bring their lines: the same hypotheses as by a join, and no text in a shuffle."""

import random
import time

import duckdb
import pytest

from atril import fixtures, queries
from atril.functions import batch, scoring
from atril.operators import clip_scores, hypotheses

LINE = "line_no long, hyp string, secs double, error string"


def test_nested_is_joined(spark):
    rng = random.Random(4)
    clips = [(k, [(n, rng.choice([None, "", "a b"]), rng.choice([None, 1.5]), rng.choice([None, None, "", "failed"])) for n in rng.sample(range(9), rng.randint(0, 3))]) for k in range(400)]
    own = spark.createDataFrame(clips, f"clip_id long, lines array<struct<{LINE}>>")
    lines = spark.createDataFrame([(k, *x) for k, found in clips for x in found], f"clip_id long, {LINE}")
    names = ("clip_id", "hyp", "secs", "error", "missing")
    want = {tuple(r) for r in hypotheses.joined(own.select("clip_id"), lines).select(*names).collect()}
    assert {tuple(r) for r in hypotheses.nested(own).select(*names).collect()} == want and len(want) == 400


def test_facts_shuffle_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "a b c " * 40, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.clip_alignment_counts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1


def test_words_part_at_spaces_only(spark, tmp_path):
    """Other white space is part of a word, as in SQL."""
    texts = ["uno dos tres cuatro\u000bcinco seis siete ocho nueve diez " * 4, "", None, " ", "a " * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("clip_alignment_counts", "term_counts", "degenerate_clips"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(db.execute(queries.ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("n", [60_000])
def test_pairs_a_second(n):
    """From Arrow columns, as a worker gets them: some 80 microseconds a pair when words were strings."""
    import pyarrow as pa

    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    refs = [rng.choices(words, k=24) for _ in range(2000)] * (n // 2000)
    hyps, terms = [" ".join(r[:20] + r[21:]) for r in refs], [[r[2], f"{r[6]} {r[7]}"] for r in refs]
    ref, hyp, term = pa.array(refs), pa.array(hyps), pa.array(terms)
    began = time.process_time()
    for k in range(0, n, clip_scores.ROWS):
        batch.facts_in(batch.listed(ref.slice(k, clip_scores.ROWS)), batch.spaced(hyp.slice(k, clip_scores.ROWS)), batch.listed(term.slice(k, clip_scores.ROWS)), False)
    assert (time.process_time() - began) / n < 40e-6


def test_lines_of_both_systems(spark, tmp_path):
    spark.createDataFrame([(k, "uno dos tres cuatro cinco " * (k % 9), "s") for k in range(60)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    both = fixtures.lined(spark, str(tmp_path), 1, 2)
    for q in (1, 2):
        assert sorted(map(tuple, both.where(f"system = {q}").selectExpr("clip_id", "inline(lines)").collect()), key=str) == sorted(map(tuple, fixtures.hyps(spark, str(tmp_path), q).collect()), key=str)


def test_only_the_facts_asked_for_are_made(spark, tmp_path, monkeypatch):
    """Alike with or without the others; flags without an alignment, edits without a search for loops or terms."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["uno", "dos", "de", "la", "tres"], k=rng.choice([0, 3, 24, 90]))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    whole = queries.scores(spark, str(tmp_path)).orderBy("system", "clip_id").collect()
    for part, names in (("edits", scoring.FIELDS[:5]), ("terms", scoring.FIELDS[5:]), ("flags", ("degenerate", "detail"))):
        own = queries.scores(spark, str(tmp_path), part)
        assert own.columns == ["system", "clip_id", "block", "condition", *names]
        assert [tuple(r) for r in own.orderBy("system", "clip_id").collect()] == [tuple(r[c] for c in own.columns) for r in whole]
    sides = [batch.column_of([t.split()[:24] for t in texts])] * 2
    terms = batch.column_of([["uno", "de la"]] * len(texts))

    def never(*_):
        raise AssertionError

    for part, unused in (("flags", "edits_of"), ("edits", "_may_loop")):
        with monkeypatch.context() as m:
            m.setattr(batch, unused, never)
            batch.facts_in(*sides, terms, False, (part,))
