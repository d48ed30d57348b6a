"""Token counts that follow edits.

Each document has a segment tree: its leaves are runs of words as the pre-tokenizer separates them (about ``LEAF``
words, cut at single spaces between characters that are not white space, where no pre-token reaches across), its inner
nodes sums of characters and tokens. An edit finds its leaf by the sums, re-encodes the leaves that it touches and
one more on each side whose boundary it may have changed, and updates the sums on the way up.

Nulls count as empty texts with no tokens. Edits apply in order; positions are cut to the text that is there. Null
edits are skipped. Repeated rows are counted each for itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
LEAF = 16
#: Words whose counts a worker keeps.
CACHE = 300_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


@cache
def encoding(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counts(dict):
    """Tokens of a word (with the space before it); forgets all once it holds too many."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = n = len(self.encode(word))
        return n


@cache
def counts(path: str) -> Counts:
    return Counts(path)


def words(text: str) -> list[str]:
    """Stretches that tokenize independently; all but the first begin with their space."""
    if not text:
        return []
    first, *rest = _CUT.split(text)
    return [first, *(" " + w for w in rest)]


class Tree:
    """Segment tree over leaves of text: node k has children 2k and 2k+1."""

    def __init__(self, text: str, count: Counts):
        self.count, self.encoded = count, 0
        self._build(self._leaves(text))

    def _leaves(self, text: str) -> list[tuple[str, int]]:
        parts = words(text)
        self.encoded += len(parts)
        each = list(map(self.count.__getitem__, parts))
        return [("".join(parts[k : k + LEAF]), sum(each[k : k + LEAF])) for k in range(0, len(parts), LEAF)]

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.text = [t for t, _ in leaves] + [""] * (self.size - len(leaves))
        self.chars, self.tokens = ([0] * (2 * self.size) for _ in range(2))
        for k, (t, n) in enumerate(leaves):
            self.chars[self.size + k], self.tokens[self.size + k] = len(t), n
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it starts; the last leaf for the end of the text."""
        k, start = 1, 0
        at = min(at, self.chars[1] - 1) if self.chars[1] else 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def total(self) -> int:
        return self.tokens[1]

    def whole(self) -> str:
        return "".join(self.text)

    def edit(self, at: int, drop: int, put: str) -> None:
        """Replace ``drop`` characters at ``at`` by ``put``."""
        at = max(0, min(at, self.chars[1]))
        drop = max(0, min(drop, self.chars[1] - at))
        first, start = self.find(max(0, at - 1))
        last, _ = self.find(at + drop)
        # the leaves next to those touched: their ends are boundaries only if the characters there still are what they were
        while first > 0 and (at - start < 2 or not self.text[first]):
            first -= 1
            start -= self.chars[self.size + first]
        last = min(last + 1, self.size - 1)
        old = "".join(self.text[first : last + 1])
        new = old[: at - start] + put + old[at - start + drop :]
        leaves = self._leaves(new)
        room = last - first + 1
        if len(leaves) > room:
            if len(leaves) > 4 * room + 4:
                kept = [(self.text[k], self.tokens[self.size + k]) for k in range(self.size)]
                self._build([x for x in kept[:first] if x[0]] + leaves + [x for x in kept[last + 1 :] if x[0]])
                return
            merge = -(-len(leaves) // room)
            leaves = [("".join(t for t, _ in leaves[k : k + merge]), sum(n for _, n in leaves[k : k + merge])) for k in range(0, len(leaves), merge)]
        leaves += [("", 0)] * (room - len(leaves))
        for k, (t, n) in enumerate(leaves, first):
            self.text[k] = t
            self.chars[self.size + k], self.tokens[self.size + k] = len(t), n
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for k in range(low, high + 1):
                self._sum(k)
            low, high = low // 2, high // 2


EDITS = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("drop", T.LongType()), T.StructField("put", T.StringType())]))


def count_edits(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Token counts of ``docs`` (doc_id, text, edits) before and after its edits, with the words encoded for each. No shuffle."""
    rows = docs.select("doc_id", "text", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts(path)
        for b in batches:
            out = []
            for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tree = Tree(text or "", count)
                before, built, tree.encoded = tree.total(), tree.encoded, 0
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["at"] or 0, e["drop"] or 0, e["put"] or "")
                out.append((before, tree.total(), tree.chars[1], built, tree.encoded))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "words_encoded", "words_reencoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_tokens_edited long, n_chars_edited long, words_encoded long, words_reencoded long")


def sample_edits() -> Column:
    """Three edits by rule: words put in at a third, characters dropped at the middle, a stretch replaced near the end."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    one = lambda at, drop, put: F.struct(at.cast("long").alias("at"), F.lit(drop).cast("long").alias("drop"), put.alias("put"))
    return F.array(one(F.floor(n / 3), 0, F.concat(F.lit(" revision "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), one(F.floor(n / 2), 7, F.lit("")), one(F.floor(n * 9 / 10), 12, F.lit("\n\nnew line's end ")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: counts of every document before and after three edits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_edits(docs.withColumn("edits", sample_edits()))
