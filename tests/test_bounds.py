"""What queries hold, move and scan, by their plans and by what a worker makes at once."""

import random

import pyarrow as pa
import pytest

from atril import queries
from atril.functions import normalizer
from atril.operators import bootstrap, metrics


def test_tokens_a_bounded_number_at_once(spark, monkeypatch):
    """Spark's batches have 10,000 rows; what goes back of one comes in parts."""
    texts = [(k, t) for k, t in enumerate([None, "", "Treinta y dos años", "hola " * 50, "él, 3,5 mg"] * 40)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.tokens for r in normalizer.tokenized(rows).collect()} == {k: normalizer.tokenize(t) for k, t in texts}
    made = []
    monkeypatch.setattr(normalizer, "HELD", 1000)
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: made.append(f))
    normalizer.tokenized(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts]), pa.array([t for _, t in texts])], ["doc_id", "text"])
    parts = list(made[0](iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(parts).to_pydict() == {"doc_id": [k for k, _ in texts], "tokens": [normalizer.tokenize(t) for _, t in texts]}
    assert max(sum(map(len, p.column(1).flatten().to_pylist())) for p in parts) <= 1000 + 250 and len(parts) > 5


def test_only_stretches_with_a_texts_hash_move(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, f"a x{k} y " * 50 + ("a b c" if k == 3 else "")) for k in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.span_contains(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") > plan.index("Aggregate [doc_id")  # the tree is printed from the top: first hashes, then distinct


def facts(spark, n: int = 300):
    rng = random.Random(5)
    rows = [(q, f"b{k % 11}", "clean" if k % 2 else "degraded", *(rng.randint(0, 9) for _ in range(9)), ["loop"] * (k % 7 == 0)) for k in range(n) for q in (1, 2)]
    return spark.createDataFrame(rows, "system int, block string, condition string, s long, d long, i long, n_ref long, term_hits long, term_n long, term_word_errors long, term_words long, other_word_errors long, degenerate array<string>").withColumn("other_words", bootstrap.F.lit(0))


def test_all_paired_are_each_paired(spark):
    """A metric without a denominator (other_words) is left out."""
    rows = facts(spark)
    got = {r.metric: tuple(r)[:-1] for r in bootstrap.every_paired(rows, 1, 2, 100).collect()}
    want = {m: tuple(bootstrap.paired(rows, m, 1, 2, 100).first()) for m in metrics.METRICS}
    assert want.pop("other_word_error_rate")[2] is None and set(got) == set(want)
    for m, told in want.items():
        assert got[m] == pytest.approx(told)


@pytest.mark.parametrize("ask", [lambda f: bootstrap.every_paired(f, 1, 2), lambda f: bootstrap.every_metric(f, "system"), lambda f: bootstrap.ratio_ci(f, "wer", "system"), lambda f: bootstrap.paired(f, "wer", 1, 2), lambda f: bootstrap.macro_ci(f, "wer", "condition")])
def test_facts_are_made_once(spark, ask):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = facts(spark)
    ask(rows.mapInArrow(counted, rows.schema)).collect()
    spark.catalog.clearCache()
    assert made.value == 600
