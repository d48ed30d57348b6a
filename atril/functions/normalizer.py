"""Spanish text normalizer: text to the tokens that all metrics count."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as lx

VERSION = "es1+lc1"
#: Characters of text whose tokens a worker holds at once.
HELD = 1 << 20
_WORD = re.compile(r"[^\W\d_]+|\d+")
_NUMBER = re.compile(r"\d+(?:,\d+)?\Z")
# Patterns of the cleaning steps, in their order, and what each match becomes. \x01 stands for a decimal mark.
CLEANING = (
    (re.compile(r"(?<=\d)[.,](?=\d)"), "\x01"),
    (re.compile(r"[/\-\u2010\u2011\u2012\u2013\u2014_]"), " "),
    (re.compile(r"[^\w\s%º\x01]"), " "),
    (re.compile(r"(\d)([^\W\d_])"), r"\1 \2"),
    (re.compile(r"([^\W\d_])(\d)"), r"\1 \2"),
    (re.compile(r"(\d)(%)"), r"\1 \2"),
)
#: A letter for each kind of number word: hundreds, tens, zero, one to nine, other units, scales, "y", decimal marks.
_KIND = {w: "h" for w in lx.HUNDREDS} | {w: "t" for w in lx.TENS} | {w: "z" if n == 0 else "u" if n < 10 else "v" for w, n in lx.UNITS.items()} | {w: "s" for w in lx.SCALES} | {"y": "y"} | {w: "c" for w in lx.DECIMAL_MARKS}
_VALUE = lx.HUNDREDS | lx.TENS | lx.UNITS
#: Number words as a language over these letters. A group is hundreds with tens or units after them; a number is groups
#: with a scale each and a last one without, then perhaps a decimal mark and digits.
_GROUP = r"(?:h(?:t(?:yu)?|[uvz])?|t(?:yu)?|[uvz])"
_SCALED = re.compile(rf"({_GROUP}?)(s)|({_GROUP})")
_SPOKEN = re.compile(rf"((?:{_GROUP}?s)*{_GROUP}?)(?:c([uz]+))?")
_UNIT_STARTS = frozenset(name.split()[0] for name in lx.UNIT_NAMES)
_UNITS = lx.UNIT_SPELLINGS | lx.UNIT_NAMES
#: A number and a unit after it, units of more words first.
_MEASURE = re.compile(rf"(?<!\S)(\d+(?:,\d+)?) ({'|'.join(map(re.escape, sorted(_UNITS, key=lambda name: (-len(name.split()), name))))})(?!\S)")


def spelled(text: str) -> str:
    """Spelled-out initialisms joined: "pe ce erre" becomes "pcr". All other text stays as it is."""
    runs: list[list[tuple[str, int, int]]] = []
    run: list[tuple[str, int, int]] = []
    for m in _WORD.finditer(text):
        word, gap = m[0].lower(), text[run[-1][2] : m.start()] if run else ""
        joins = bool(gap) and not gap.strip(" \t-") and (word in lx.LETTERS or word in lx.DIGITS and run[-1][0] in lx.LETTERS and run[-1][0] != "de")
        if not joins:
            runs.append(run)
            run = []
        if joins or word in lx.LETTERS:
            run.append((word, m.start(), m.end()))
    out, done = [], 0
    for r in [*runs, run]:
        while r and r[0][0] in lx.EDGES:
            r = r[1:]
        while r and r[-1][0] in lx.EDGES:
            r = r[:-1]
        while r and r[0][0] in lx.DIGITS:
            r = r[1:]
        names = [w for w, *_ in r]
        if 2 <= len(names) <= lx.LONGEST_RUN and max(Counter(names).values()) < 3 and any(w in lx.LETTERS and w not in lx.VOWELS for w in names):
            out += [text[done : r[0][1]], "".join(lx.LETTERS.get(w) or lx.DIGITS[w] for w in names)]
            done = r[-1][2]
    return "".join(out) + text[done:]


def cleaned(text: str) -> str:
    """NFC, lower case, no punctuation; a mark between digits becomes a decimal comma, glued digits and letters part."""
    text = unicodedata.normalize("NFC", text).lower()
    for pattern, into in CLEANING:
        text = pattern.sub(into, text)
    return " ".join(text.replace("\x01", ",").split())


def is_number(token: str) -> bool:
    return _NUMBER.match(token) is not None


def _valued(words: list[str], kinds: str) -> int:
    """Value of number words that ``_SPOKEN`` met: each scaled group, a bare scale counting once, and the last group."""
    total = 0
    for m in _SCALED.finditer(kinds):
        size = sum(_VALUE.get(w, 0) for w in words[m.start() : m.end()])
        total += (size or 1) * lx.SCALES[words[m.end() - 1]] if m[2] else size
    return total


def in_digits(tokens: list[str]) -> list[str]:
    """Number words as digits. "un", "una", "uno" alone stay articles unless a unit may begin after them."""
    kinds, out, at = "".join(_KIND.get(t, ".") for t in tokens), [], 0
    while at < len(tokens):
        met = _SPOKEN.match(kinds, at)
        end = met.end() if met[1] else at
        if end == at + 1 and tokens[at] in lx.ARTICLES and not _UNIT_STARTS.intersection(tokens[end : end + 1]):
            end = at
        if end == at:
            out.append(tokens[at])
            at += 1
            continue
        text = str(_valued(tokens[at : met.end(1)], met[1]))
        out.append(text + ("," + "".join(str(lx.UNITS[t]) for t in tokens[met.start(2) : end]) if met[2] else ""))
        at = end
    return out


def with_units(tokens: list[str]) -> list[str]:
    """Units after a number in their short form, the longest name first."""
    return _MEASURE.sub(lambda m: f"{m[1]} {_UNITS[m[2]]}", " ".join(tokens)).split()


def unconnected(tokens: list[str]) -> list[str]:
    """Without the connectors that stand between two numbers."""
    around = zip(["", *tokens], tokens, [*tokens[1:], ""], strict=False)
    return [t for before, t, after in around if not (t in lx.CONNECTORS and is_number(before) and is_number(after))]


@lru_cache(maxsize=4096)
def _short(text: str) -> tuple[str, ...]:
    return _tokens(text)


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(unconnected(with_units(in_digits(cleaned(spelled(text)).split()))))


def tokenize(text: str | None) -> list[str]:
    """Tokens; short texts, such as terms, are kept for the next time, so what a worker keeps is bounded."""
    text = text or ""
    return list(_short(text) if len(text) <= 200 else _tokens(text))


def normalize(text: str | None) -> str:
    return " ".join(tokenize(text))


def tokenized(rows: DataFrame) -> DataFrame:
    """Tokens of each (id, text): a worker holds those of HELD characters, or of one text, whatever a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            first, held, out = 0, 0, []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                out.append(tokenize(text))
                held += len(text or "")
                if held >= HELD or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(out)), pa.array(out, pa.list_(pa.string()))], names)
                    first, held, out = k + 1, 0, []

    names = [rows.columns[0], "tokens"]
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("tokens", T.ArrayType(T.StringType()))]))


@F.pandas_udf(T.StringType())
def cleaned_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else cleaned(t))


@F.pandas_udf(T.StringType())
def normalize_udf(text: pd.Series) -> pd.Series:
    return text.map(normalize)
