"""SimHash near-duplicates by anchor points of a covering code.

Anchors are the words of a product of four perfect codes on 64 bits: Golay [23,12] twice, Hamming [15,11] and
repetition [3,1]; 2**36 anchors, covering radius 3+3+1+1. Two fingerprints at 2 or fewer differing bits have a
point within one bit of both; that point's own anchor lies within the covering radius plus one of both. So each
fingerprint is replicated to the anchors of its 65 points within one bit (about 16 differ). These are all the anchors
within radius plus threshold that can bring a pair together: the ball of radius 10 holds some 700 anchors, and the others
of them would only show pairs again.

Fingerprints are compared anchor by anchor: each anchor's group is one row, in which members are linked through the
points of that anchor that they have in common. Common points tell the same as a comparison of all pairs (a common
point within one bit means two differing bits at most, and the other way round), but a group costs in proportion to its
size. Anchors with more than ``GROUP`` members are split by point: each of their points is compared by itself, and at
most 65 fingerprints can meet there.

Nulls in ``text`` count as empty; texts without words have fingerprint zero and link like others. Very long texts are
hashed whole, in stretches. A null ``doc_id`` is larger than any other: a component's id is null only where all its ids
are. Ties need no order: equal fingerprints are one member, and a component's id is its least id however often it occurs.
Repeated rows all come back; an empty table gives no rows; columns other than doc_id and text are not read by
``near_duplicates`` and pass through ``fingerprints`` and ``stage`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fresh, materialize, pieces_of, words_of
from .graph import components

SEED, SHINGLE, BITS = 42, 3, 64
#: Members of an anchor that are compared in one row at most.
GROUP = 4096
#: Members whose points a worker holds at once.
SLICE = 1 << 14
#: Bits in which linked fingerprints differ at most.
DISTANCE = 2


def fingerprint(text: bytes) -> int:
    """SimHash over the XXH64 of all 3-word shingles, repeats included; bit 1 if set in over half of them."""
    total, n, carry = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in pieces_of(text.lower()):
        words = carry + words_of(piece)
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            sizes = list(map(len, words))
            ends = list(accumulate(sizes, lambda end, size: end + 1 + size))
            hashes = [digest(joined[e - s : z], SEED) for e, s, z in zip(ends, sizes, ends[SHINGLE - 1 :], strict=False)]
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(0, dtype=np.int64)
            n += len(hashes)
        carry = words[-SHINGLE + 1 :]
    if not n and carry:
        return digest(b" ".join(carry), SEED)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` without its text and with the fingerprint as a (signed) long. No shuffle."""
    keep = [c for c in docs.columns if c != text]
    out = [*keep, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t) for t in as_bytes(b.column(len(keep)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made)], out)

    rows = docs.select(*keep, text)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{name}` long"]))


def _remainders(width: int, generator: int, degree: int, values: np.ndarray) -> np.ndarray:
    """Remainders of binary polynomials, the syndromes of a cyclic code."""
    rest = values.copy()
    for k in range(width - 1, degree - 1, -1):
        rest ^= np.where(rest >> k & 1, generator << (k - degree), 0)
    return rest


class Cyclic:
    """A perfect cyclic code: nearest words by syndrome."""

    def __init__(self, width: int, generator: int, radius: int):
        self.width, degree = width, generator.bit_length() - 1
        errors = np.zeros(1, np.int64)
        for _ in range(radius):
            errors = np.unique(np.concatenate([errors, *(errors ^ (1 << k) for k in range(width))]))
        self.leader = np.zeros(1 << degree, np.int64)
        self.leader[_remainders(width, generator, degree, errors)] = errors
        half = np.arange(1 << 12)
        self.low, self.high = (_remainders(width, generator, degree, part & (1 << width) - 1) for part in (half, half << 12))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return x ^ self.leader[self.low[x & 0xFFF] ^ self.high[x >> 12]]


_codes: list[tuple[int, Cyclic]] = []


def codes() -> list[tuple[int, Cyclic]]:
    """(first bit, code). Generators: of the Golay code x^11+x^10+x^6+x^5+x^4+x^2+1, Hamming x^4+x+1, repetition x^2+x+1."""
    if not _codes:
        golay = Cyclic(23, 0b110001110101, 3)
        _codes.extend([(0, golay), (23, golay), (46, Cyclic(15, 0b10011, 1)), (61, Cyclic(3, 0b111, 1))])
    return _codes


def points(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 65 points within one bit of each fingerprint, and the anchor of each."""
    fp = fp.view(np.uint64)[:, None]
    at = fp ^ np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(BITS, dtype=np.uint64)])[None, :]
    anchor = np.zeros_like(at)
    for first, code in codes():
        part = (at >> np.uint64(first)) & np.uint64((1 << code.width) - 1)
        anchor |= code.nearest(part.astype(np.int64)).astype(np.uint64) << np.uint64(first)
    return at.view(np.int64), anchor.view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        if len(fp):
            anchor = np.sort(points(fp)[1], 1)
            first = np.concatenate([np.ones((len(fp), 1), bool), anchor[:, 1:] != anchor[:, :-1]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, first.sum(1))), pa.array(anchor[first])], ["fp", "anchor"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, anchor = b.column(0).to_numpy(), b.column(1).to_numpy()
        if len(fp):
            at, own = points(fp)
            mine = own == anchor[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, mine.sum(1))), pa.array(at[mine])], ["fp", "point"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each anchor's group: of the members at one of the anchor's points, each is linked with the least."""
    for batch in batches:
        anchors, groups = batch.column(0).to_numpy(), batch.column(1)
        size = groups.value_lengths().to_numpy(zero_copy_only=False)
        ends = size.cumsum()
        for k in np.split(np.arange(len(size)), np.flatnonzero(np.diff(ends // SLICE)) + 1):
            if not len(k):
                continue
            fp = groups.slice(k[0], len(k)).flatten().to_numpy()
            group = np.repeat(k, size[k])
            at, own = points(fp)
            member, place = np.nonzero(own == anchors[group][:, None])
            group, point, fp = group[member], at[member, place], fp[member]
            order = np.lexsort((fp, point, group))
            group, point, fp = group[order], point[order], fp[order]
            opens = np.concatenate([[True], (point[1:] != point[:-1]) | (group[1:] != group[:-1])])
            least = fp[np.flatnonzero(opens)[opens.cumsum() - 1]]
            near = (fp != least) & (np.bitwise_count((fp ^ least).view(np.uint64)) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([pa.array(fp[near]), pa.array(least[near])], ["a", "b"])


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between different fingerprints at 2 or fewer bits that hold each other's groups together."""
    members = distinct.select("fp").mapInArrow(_anchors, "fp long, anchor long")
    shared = materialize(members.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    met = members.join(shared, "anchor")
    rows = met.where(F.col("n") <= group).groupBy("anchor").agg(F.collect_list("fp").alias("fps"))
    within = rows.mapInArrow(_compared, "a long, b long")
    if not shared.where(F.col("n") > group).limit(1).count():
        return within.distinct()
    split = met.where(F.col("n") > group).select("fp", "anchor").mapInArrow(_points, "fp long, point long")
    at = split.groupBy("point").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # 65 at most
    across = at.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where(f"a <> b and bit_count(a ^ b) <= {DISTANCE}")
    return within.unionAll(across).distinct()


def classes(fps: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``fps`` (doc_id, fp); root: the component's least fingerprint."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    joined = components(materialize(links(distinct), "links"))
    rooted = distinct.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(ids, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text)."""
    fps = materialize(fingerprints(docs.select("doc_id", "text")), "rows")
    return fps.join(classes(fps), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group stays: that with the least doc_id, then the least text hash; of equal rows, one."""
    key, many, i, text_hash = fresh(docs, "text_key", "copies", "stay_id", "stay_key")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    fps = materialize(fingerprints(rows), "rows")
    mine = fps.join(classes(fps), "fp").where("doc_id <=> component_id")
    each = mine.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "copies")).alias("first"))
    stay = materialize(first.select(F.col("first.doc_id").alias(i), F.col("first.text_key").alias(text_hash), F.col("first.copies").alias(many)), "stay")
    columns = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64("text"))
    on = keyed["doc_id"].eqNullSafe(stay[i]) & (keyed[key] == stay[text_hash])
    once = keyed.join(stay.where(f"`{many}` = 1"), on, "left_semi").select(*columns)
    again = keyed.join(stay.where(f"`{many}` > 1"), on, "left_semi").dropDuplicates(["doc_id", key]).select(*columns)
    return once.unionAll(again)
