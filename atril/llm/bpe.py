"""BPE encoding and decoding over a distinct-word table.

Texts are split into words that the byte-level pre-tokenizer cannot join: at each single space between two characters
that are not white space. A pre-token takes in a space only before other characters and looks at most at the run of
white space that follows it, so cutting there changes no pre-token; a stretch with longer runs of white space at such
a place stays one word. The tokenizers library encodes each distinct word once, so special tokens, alphabets and
merges are its own.

Plan: documents go into chunks of about 16 MB, each with its own word list and each text as positions in that list.
Word lists are dealt by word; each part encodes its distinct words once and keeps them as its share of the written word
table (word, ids), and answers each chunk with the ids of its words in the order of its list. Positions and answers meet
by chunk, where ids are joined back by position. What moves is compressed: about two bytes a word. A row a token, for a
join of single ids with the id-to-piece table, would move some twenty bytes a token, over ten times the input; that table
has one row for each id of the vocabulary (its size is fixed by the file), so each worker holds it and decoding takes
pieces by id, as a broadcast join would.

A chunk's name holds a digest of its word list: were a chunk to come out differently when a lost executor's work is
redone, its ids would be missing and the job would stop rather than give wrong ids. Nulls count as empty texts, which
have no ids; texts of any length count whole; repeated rows and null ids all come back; an empty table gives no rows;
columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Index, chunked, dealt, materialize, pack, unpack

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of text in a chunk, and documents whose ids are joined at once.
CHUNK, DOCUMENTS = 16 << 20, 256
_REGULAR = re.compile(r"(?<=\S) (?=\S)")
_IRREGULAR = re.compile(r"\s | \s|\A | \Z")


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def split(text: str) -> list[str]:
    """Words of ``text``; joined by single spaces they give it back."""
    return _REGULAR.split(text) if _IRREGULAR.search(text) else text.split(" ")


@cache
def pieces(path: str) -> pa.Array:
    """The id-to-piece table: bytes of each id, in the order of ids."""
    spec = json.load(open(path, encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    by_id = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    by_id |= {t["id"]: bytes(letters[c] for c in t["content"]) for t in spec["added_tokens"]}
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary())


def _index(chunk: list[tuple], ways: int) -> tuple[str, list[list[bytes]], np.ndarray, list[int]]:
    """Name, words dealt ``ways`` ways, positions in the dealt order, words a text."""
    index, sizes, parts = Index(), [], []
    for _, text in chunk:
        first, *rest = split(text.decode())
        words = [(first,), *rest] if first or rest else []
        sizes.append(len(words))
        parts.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
    keys = [w[0].encode() if type(w) is tuple else b" " + w.encode() for w in index]
    way = np.fromiter((zlib.crc32(k) % ways for k in keys), np.int64, len(keys))
    order = np.argsort(way, kind="stable")
    place = np.empty(len(keys), np.uint32)
    place[order] = np.arange(len(keys), dtype=np.uint32)
    hands: list[list[bytes]] = [[] for _ in range(ways)]
    digest = hashlib.sha1()
    for k in order:
        hands[way[k]].append(keys[k])
    for hand in hands:
        for k in hand:
            digest.update(b"%d:" % len(k) + k)
    positions = place[np.concatenate(parts)] if parts else place[:0]
    return digest.hexdigest(), hands, positions, sizes


def _named(chunks: Iterator[list[tuple]], ways: int) -> Iterator[tuple]:
    task = TaskContext.get().partitionId()
    for k, chunk in enumerate(chunks):
        digest, *rest = _index(chunk, ways)
        yield f"{task}-{k}-{digest}", chunk, *rest


PART = "kind string, chunk string, way int, sizes binary, ids binary, word binary, word_ids array<int>"
_PART = [("kind", pa.string()), ("chunk", pa.string()), ("way", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary()), ("word", pa.binary()), ("word_ids", pa.list_(pa.int32()))]


def _words(ways: int):
    """Word lists of chunks, dealt by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for name, _, hands, _, _ in _named(chunked(batches, CHUNK), ways):
            made = [(way, squeeze(np.array([len(k) for k in hand], np.uint32).tobytes() + b"".join(hand)), len(hand)) for way, hand in enumerate(hands) if hand]
            if made:
                way, blob, n = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(way, pa.int32()), pa.array([name] * len(way)), pa.array(blob, pa.binary()), pa.array(n, pa.int32())], ["way", "chunk", "words", "n"])

    return run


def _encoded(path: str):
    """A part: its distinct words with their ids, and the chunks' answers."""

    def run(asked: pa.Table) -> pa.Table:
        index, places = Index(), []
        for blob, n in zip(asked["words"].to_pylist(), asked["n"].to_pylist(), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(blob)
            sizes = np.frombuffer(raw, np.uint32, n)
            ends = sizes.cumsum(dtype=np.int64) + 4 * n
            places.append(np.fromiter((index[raw[e - s : e]] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)), np.int64, n))
        distinct, ids = list(index), []
        for at in range(0, len(distinct), 4096):
            ids += [e.ids for e in tokenizer(path).encode_batch([k.decode() for k in distinct[at : at + 4096]], add_special_tokens=False)]
        table = pa.array(ids, pa.list_(pa.int32()))
        made = [table.take(pa.array(a)) for a in places]
        answers = len(made)
        none = lambda k: [None] * k
        columns = [
            ["answer"] * answers + ["word"] * len(distinct),
            asked["chunk"].to_pylist() + none(len(distinct)),
            asked["way"].to_pylist() + asked["way"].to_pylist()[:1] * len(distinct),
            [pack(m.value_lengths().to_numpy().astype(np.uint32)) for m in made] + none(len(distinct)),
            [pack(m.flatten().to_numpy()) for m in made] + none(len(distinct)),
            none(answers) + distinct,
        ]
        arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _PART, strict=False)]
        held = pa.concat_arrays([pa.nulls(answers, pa.list_(pa.int32())), table])
        return pa.table([*arrays, held], names=[n for n, _ in _PART])

    return run


def word_table(docs: DataFrame, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The distinct-word table (word, ids) of ``docs`` (doc_id, text), and the answers to its chunks; both are written."""
    spark = docs.sparkSession
    asked = docs.select("doc_id", "text").mapInArrow(_words(dealt(spark)), "way int, chunk string, words binary, n int")
    told = materialize(asked.groupBy("way").applyInArrow(_encoded(path), PART), "words", "kind")
    return told.where("kind = 'word'").select("word", F.col("word_ids").alias("ids")), told.where("kind = 'answer'").select("chunk", "way", "sizes", "ids")


def encode(docs: DataFrame, path: str = VOCABULARY, then: tuple | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text).

    then: (function of a pyarrow table doc_id, ids; schema of its result), to be applied in the worker that joined the
    ids, so that a task has one Python worker.
    """
    ways = dealt(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    arrow_id = to_arrow_type(rows.schema["doc_id"].dataType)
    _, answers = word_table(rows, path)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk, _, positions, sizes in _named(chunked(batches, CHUNK), ways):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([[i for i, _ in chunk]], pa.list_(arrow_id)), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(positions)], pa.binary())], ["chunk", "doc_ids", "sizes", "positions"])

    def joined(texts: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("way")
        sizes = [unpack(b, np.uint32).astype(np.int64) for b in replies["sizes"].to_pylist()]
        flat = [unpack(b, np.int32) for b in replies["ids"].to_pylist()]
        sizes, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, flat))
        if sizes.sum() != len(flat):
            raise RuntimeError(f"{len(flat)} ids came back where words have {sizes.sum()}")
        words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32)), pa.array(flat.astype(np.int32)))
        out_ids, out = [], []
        for r in texts.to_pylist():
            at, ends = unpack(r["positions"], np.uint32), np.concatenate([[0], np.cumsum(r["sizes"], dtype=np.int64)]).astype(np.int64)
            if len(at) and at.max() >= len(words):
                raise RuntimeError(f"chunk {r['chunk']} was not built alike twice: give the operator a written table")
            for k in range(0, len(r["doc_ids"]), DOCUMENTS):
                cut = ends[k : k + DOCUMENTS + 1]
                got = words.take(pa.array(at[cut[0] : cut[-1]]))
                upto = np.concatenate([[0], got.value_lengths().to_numpy().astype(np.int64).cumsum()])
                out.append(pa.ListArray.from_arrays(pa.array(upto[cut - cut[0]].astype(np.int32)), got.flatten()))
                out_ids.append(pa.array(r["doc_ids"][k : k + DOCUMENTS], arrow_id))
        table = pa.table({"doc_id": pa.chunked_array(out_ids, arrow_id), "ids": pa.chunked_array(out, pa.list_(pa.int32()))})
        return then[0](table) if then else table

    texts = rows.mapInArrow(places, f"chunk string, doc_ids array<{id_type}>, sizes array<int>, positions binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(joined, then[1].format(id_type) if then else f"doc_id {id_type}, ids array<int>")


def decode_ids(ids: pa.Array, path: str = VOCABULARY) -> list[bytes]:
    """Bytes of each list of ids: the flat ids taken from the id-to-piece table lie one after the other."""
    found = pieces(path).take(ids.flatten())
    ends = np.concatenate([[0], pa.compute.binary_length(found).to_numpy(zero_copy_only=False).cumsum()])
    bounds = ends[np.concatenate([[0], ids.value_lengths().to_numpy(zero_copy_only=False).cumsum()]).astype(np.int64)].astype(np.int64)
    data = found.buffers()[2]
    start = int(np.frombuffer(found.buffers()[1], np.int64, 1, 8 * found.offset)[0]) if len(found) else 0
    view = memoryview(data)[start:] if data else memoryview(b"")
    return [bytes(view[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``encoded`` with the text of its ``ids`` in a column ``decoded``; bytes that are no UTF-8 become U+FFFD. No shuffle."""
    at, columns = encoded.columns.index("ids"), [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.decode(errors="replace") for t in decode_ids(b.column(at), path)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], columns)

    schema = T.StructType(list(encoded.schema.fields)).add("decoded", "string")
    return encoded.mapInArrow(run, schema)


def digests(path: str = VOCABULARY) -> tuple:
    """For ``encode``: n_tokens, SHA-256 of the ids (little-endian) and of the text decoded from them."""

    def made(table: pa.Table) -> pa.Table:
        sums, texts, sizes = [], [], []
        for ids in table["ids"].chunks:
            for at in range(0, len(ids), 256):
                part = ids.slice(at, 256)
                flat = part.flatten().to_numpy().astype("<u4")
                n = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], n.cumsum()])
                sizes.append(n)
                sums += [hashlib.sha256(flat[a:z].tobytes()).hexdigest() for a, z in zip(ends[:-1], ends[1:], strict=True)]
                texts += [hashlib.sha256(t.decode(errors="replace").encode()).hexdigest() for t in decode_ids(part, path)]
        return pa.table({"doc_id": table["doc_id"], "n_tokens": np.concatenate(sizes) if sizes else np.zeros(0, np.int64), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(texts, pa.string())})

    return made, "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string"


def run(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return encode(docs, path, digests(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: ids and decoded text of every document, as digests."""
    return run(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the same for the documents that are left."""
    return run(docs)
