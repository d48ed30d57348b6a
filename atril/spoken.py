"""Spoken forms made from numbers, so that the normalizer can be held against what they were made from, in any engine.

Rows come from ``orders``: n is the key modulo a million. The Spark side says n in Spanish words (a number, a decimal, a
number with a unit, two numbers with a connector, an initialism by letter names); the SQL side only states the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon as lx
from .functions import normalizer

UNITS = {n: w for w, n in reversed(lx.UNITS.items())}
TENS = {n // 10: w for w, n in lx.TENS.items()}
HUNDREDS = {n // 100: w for w, n in reversed(lx.HUNDREDS.items())}
#: Units with one name each, and letter names that are no other words.
MEASURES = sorted({short: name for name, short in reversed(lx.UNIT_NAMES.items())}.items())
LETTERS = [(name, letter) for name, letter in lx.LETTERS.items() if name not in lx.EDGES and letter not in lx.VOWELS and len(letter) == 1 and letter not in "dy"]
CONNECTORS = sorted(lx.CONNECTORS)


#: "ciento" is a number before "por ciento" is looked for, so that becomes this.
SHOWN = {"%": "por 100"}


def _pick(words: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), k.cast("int") + 1)


def _hundreds(n: Column) -> Column:
    """Words of a number from 1 to 999."""
    h, r = F.floor(n / 100), n % 100
    upper = F.when(h == 0, "").when((h == 1) & (r == 0), "cien").when(h == 1, "ciento").otherwise(_pick([HUNDREDS.get(k, "") for k in range(10)], h))
    tens = F.concat(_pick([TENS.get(k, "") for k in range(10)], F.floor(r / 10)), F.when(r % 10 > 0, F.concat(F.lit(" y "), _pick([UNITS[k] for k in range(10)], r % 10))).otherwise(""))
    lower = F.when(r == 0, "").when(r < 30, _pick([UNITS[k] for k in range(30)], F.least(r, F.lit(29)))).otherwise(tens)
    return F.trim(F.concat_ws(" ", upper, lower))


def number(n: Column) -> Column:
    """Spanish words of a number below a million."""
    thousands = F.when(n < 1000, "").when(n < 2000, "mil").otherwise(F.concat(_hundreds(F.floor(n / 1000)), F.lit(" mil")))
    return F.when(n == 0, "cero").otherwise(F.trim(F.concat_ws(" ", thousands, F.when(n % 1000 > 0, _hundreds(n % 1000)).otherwise(""))))


def _said(spark: SparkSession, sf_dir: str, said) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 1_000_000).alias("n"))
    return rows.select("o_orderkey", normalizer.normalize_udf(said(F.col("n"))).alias("text"))


def number_words(spark, sf_dir):
    return _said(spark, sf_dir, number)


def decimal_words(spark, sf_dir):
    return _said(spark, sf_dir, lambda n: F.concat_ws(" ", number(n), F.when(n % 2 == 0, "coma").otherwise("punto"), _pick([UNITS[k] for k in range(10)], n % 10), _pick([UNITS[k] for k in range(10)], F.floor(n / 10) % 10)))


def unit_words(spark, sf_dir):
    return _said(spark, sf_dir, lambda n: F.concat_ws(" ", number(n), _pick([name for _, name in MEASURES], n % len(MEASURES))))


def connector_words(spark, sf_dir):
    return _said(spark, sf_dir, lambda n: F.concat_ws(" ", (n % 97 + 2).cast("string"), _pick(CONNECTORS, n % len(CONNECTORS)), F.when(n % 5 == 0, "fin").otherwise((n % 89 + 2).cast("string"))))


def letter_words(spark, sf_dir):
    k, names = len(LETTERS), [name for name, _ in LETTERS]
    return _said(spark, sf_dir, lambda n: F.concat_ws(" ", F.lit("ver"), *(_pick(names, F.floor(n / k**j) % k) for j in range(3)), F.lit("hoy")))


QUERIES = {f.__name__: f for f in (number_words, decimal_words, unit_words, connector_words, letter_words)}


def _case(values: list[str], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][1 + ({at})::INT]"


_ROWS = "WITH t AS (SELECT o_orderkey, o_orderkey % 1000000 AS n FROM orders)"
_L = len(LETTERS)
_AT = [f"n // {_L**j} % {_L}" for j in range(3)]
ORACLE_SQL = {
    "number_words": f"{_ROWS} SELECT o_orderkey, CASE WHEN n = 1 THEN 'uno' ELSE n::VARCHAR END AS text FROM t",
    "decimal_words": f"{_ROWS} SELECT o_orderkey, n || ',' || n % 10 || n // 10 % 10 AS text FROM t",
    "unit_words": f"{_ROWS} SELECT o_orderkey, n || ' ' || {_case([SHOWN.get(short, short) for short, _ in MEASURES], f'n % {len(MEASURES)}')} AS text FROM t",
    "connector_words": f"{_ROWS} SELECT o_orderkey, n % 97 + 2 || CASE WHEN n % 5 = 0 THEN ' ' || {_case(CONNECTORS, f'n % {len(CONNECTORS)}')} || ' fin' ELSE ' ' || (n % 89 + 2) END AS text FROM t",
    "letter_words": f"{_ROWS} SELECT o_orderkey, CASE WHEN {_AT[0]} = {_AT[1]} AND {_AT[1]} = {_AT[2]} THEN 'ver ' || {' || chr(32) || '.join(_case([n for n, _ in LETTERS], a) for a in _AT)} || ' hoy' ELSE 'ver ' || {' || '.join(_case([x for _, x in LETTERS], a) for a in _AT)} || ' hoy' END AS text FROM t",
}
