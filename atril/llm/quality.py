"""Quality rules: gradient-boosted trees over document statistics, after two base rules.

Nulls count as empty texts; an empty text has no words and fails the base rule. Rows that repeat get equal
answers; ``doc_id`` may be null or repeated. Labels that are null, or that contradict each other for one
document, are not learnt from; without labels of both kinds the base rules alone decide. Columns beyond
``doc_id`` and ``text`` pass through unread, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trees
from .common import as_bytes, fresh, words_of

SYMBOLS = b"#*$%&|<>"
#: Documents whose labels are learnt from at most, those with the smallest hashes: the bound of the training sample.
MAX_LABELS = 20_000
#: Lowest probability of good quality that is kept: doubt keeps a document.
THRESHOLD = 0.3
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols a word", "exclamations a word", "capitals", "repeated words", "repeated lines", "digits", "stops a word", "different words", "words a line", "word length", "log words")
#: More symbols, exclamations, capitals and repetition never make a document better.
MONOTONE = (-1, -1, -1, -1, -1, 0, 0, 0, 0, 0, 0)
_CAPITALS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    key = ids[:-2] * distinct + ids[1:-1]
    if distinct > 2_000_000:
        key = np.unique(key, return_inverse=True)[1]
    _, inverse, count = np.unique(key * distinct + ids[2:], return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """STATS and FEATURES of one text."""
    words = words_of(text)
    n, index = len(words), {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    solid = b"".join(words)
    chars = len(solid.decode(errors="replace"))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    repeats = repeated_words(ids, len(index))
    seen, lines, dups = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dups += line in seen
            seen.add(line)
    some, solid_n = max(n, 1), max(len(solid), 1)
    share = lambda drop: (len(solid) - len(solid.translate(None, drop))) / solid_n
    features = [symbols / some, solid.count(b"!") / some, share(_CAPITALS), repeats / some, dups / max(lines, 1), share(_DIGITS), (solid.count(b".") + solid.count(b",")) / some, len(index) / some, n / max(lines, 1), chars / some, math.log1p(n)]
    return [n, chars, symbols, dups, repeats], features


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def training_rows(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample. The sample has ``max_labels`` ids at most, so it may be broadcast; where an id
    has several texts, that with the least hash is learnt from, so as many rows at most reach the driver."""
    agreed = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    sample = agreed.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = met.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("quality", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([statistics(t)[1] for t in as_bytes(b.column(1))], pa.list_(pa.float64()))], ["quality", "x"])

    got = rows.mapInArrow(features, "quality int, x array<double>").dropDuplicates().orderBy("quality", "x").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return x, got["quality"].to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> trees.Forest | None:
    """The forest, or None where the labels do not hold both kinds."""
    x, y = training_rows(docs, labels, max_labels)
    return trees.fit(x, y, monotone=MONOTONE) if 0 < y.sum() < len(y) else None


def judge(docs: DataFrame, forest: trees.Forest | None, names: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``score`` and ``kept``; names: what to call these columns. No shuffle."""
    names = {c: c for c in (*STATS, "base_failed", "score", "kept")} | (names or {})
    at = docs.columns.index("text")
    columns = [*docs.columns, *names.values()]
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            stats, x = zip(*map(statistics, as_bytes(b.column(at))), strict=True)
            stats = np.array(stats, np.int64)
            failed = base_failed(stats[:, 0], stats[:, 4])
            p = forest.probability(np.array(x, float)) if forest else np.ones(len(failed))
            made = [*stats.T, failed, p, ~failed & (p >= threshold)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], columns)

    schema = T.StructType(list(docs.schema.fields))
    for c, kind in zip((*STATS, "base_failed", "score", "kept"), (*[T.LongType()] * 5, T.BooleanType(), T.DoubleType(), T.BooleanType()), strict=True):
        schema.add(names[c], kind)
    return docs.mapInArrow(score, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: statistics and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", *STATS, "base_failed", "kept", F.round("score", 6).alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the rules keep, with the columns that they came with."""
    columns = docs.columns
    used = dict(zip((*STATS, "base_failed", "score", "kept"), fresh(docs, *STATS, "base_failed", "score", "kept"), strict=True))
    kept: Column = F.col(f"`{used['kept']}`")
    return judge(docs, train(docs, read(spark, sf_dir, "labels")), used).where(kept).select(*(f"`{c}`" for c in columns))
