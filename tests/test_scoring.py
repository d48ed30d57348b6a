import random

import numpy as np
import pytest

from atril.functions import normalizer, scoring
from atril.operators import bootstrap, hypotheses, metrics
from atril.plans import report
from atril.sources import jsonl
from atril.streaming import turns


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Amoxicilina 875/125 mg cada 8 horas", "amoxicilina 875 125 mg cada 8 h"),
        ("ochocientos setenta y cinco barra ciento veinticinco", "875 125"),
        ("veinte y cinco", "20 5"),
        ("treinta dos", "30 2"),
        ("cero mil", "1000"),
        ("50 por ciento", "50 por 100"),
        ("un gramo", "1 g"),
        ("una casa", "una casa"),
        ("eme ge", "mg"),
        ("ache be a uno ce", "hba 1 c"),
        ("1.000.000", "1,000,000"),
        ("uno coma cinco", "1,5"),
        ("10mg", "10 mg"),
        ("tomar 5 milímetros de mercurio", "tomar 5 mmhg"),
        (None, ""),
    ],
)
def test_normalizer(text, want):
    assert normalizer.normalize(text) == want


def test_ties_go_to_insertions_late():
    counts, same = scoring.edits("no refiere alergias".split(), "no refiere alergia a la amoxicilina".split())
    assert counts[:3] == [1, 0, 3] and same == 0b11


def test_edits_have_least_cost():
    rng = random.Random(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        s, d, i, *_ = scoring.edits(a, b)[0]
        assert s + d + i == distance(a, b) and d - i == len(a) - len(b)


def test_terms_and_loops():
    facts, flags, _ = scoring.facts("dolor de fractura de fémur hoy".split(), "dolor de fractura de femur hoy".split(), ("fractura de fémur",))
    assert facts == [6, 6, 1, 0, 0, 1, 0, 0, 2, 1, 4, 0] and flags == []
    assert scoring.degenerate(["a"], [])[0] == ["empty"] and scoring.degenerate(["a"], ["b"] * 4)[0] == ["loop"]
    assert scoring.degenerate([], [])[0] == [] and scoring.loops("a b a b a b".split()) == {("a", "b")}


def test_last_success(spark):
    rows = [("a", 1, "old", 1.0, None), ("a", 2, "new", 2.0, None), ("a", 3, "", None, "bad"), ("b", 1, "", None, "x"), ("b", 2, "", None, "y")]
    lines = spark.createDataFrame(rows, "clip_id string, line_no int, hyp string, secs double, error string")
    got = {r.clip_id: (r.hyp, r.error) for r in hypotheses.last_success(lines).collect()}
    assert got == {"a": ("new", None), "b": ("", "y")}


def test_numpy_intervals():
    m = np.array([[1, 2], [2, 4], [3, 6]], float)
    assert bootstrap.numpy_ci([m]) == (0.5, 0.5, 0.5)
    same = bootstrap.numpy_paired([np.concatenate([m, m], 1)])
    assert same["delta"] == 0 and same["p_two_sided"] == 1 and not same["significant"]
    with pytest.raises(ValueError):
        bootstrap.numpy_paired([np.ones((1, 4))])


def test_jsonl(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"clip_id": "a", "hyp": "x"}\n\n{"clip_id": "b", "hyp": 3}\n[1]\n{"clip_id"', encoding="utf-8")
    rows = jsonl.lines(spark, str(tmp_path / "h.jsonl"))
    assert [(r.line_no, r.problem) for r in jsonl.problems(rows).orderBy("line_no").collect()] == [(3, "hyp is not a string"), (4, "not a JSON object"), (5, "not a JSON object")]
    with pytest.raises(jsonl.MalformedFileError):
        jsonl.read_hyps(spark, str(tmp_path / "h.jsonl"))


def test_turns_and_report(spark):
    rows = [("a", 1, "TurnInfo", "Update", 0, "ho"), ("a", 2, "TurnInfo", "EndOfTurn", 0, "Hola."), ("a", 3, "TurnInfo", "Update", 0, "late"), ("a", 4, "TurnInfo", "Update", 1, "qué tal")]
    events = spark.createDataFrame(rows, "clip_id string, seq long, kind string, event string, turn_index int, text string")
    assert turns.turns(events).first().text == "Hola. qué tal"
    assert report.unique_ids(["a", "a", "a-2"]) == ["a", "a-2", "a-2-2"]


def test_ratio_without_denominator(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0)], "s int, d int, i int, n_ref int")
    assert rows.agg(metrics.metric("wer")).first()[0] is None
