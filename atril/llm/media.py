"""Media columns: ISO media containers, read by walking their boxes.

``mux`` stores bytes as one track of 8-bit unsigned PCM in samples of 192 bytes, ``demux`` decodes the sample tables of
any such container (nested boxes, 64-bit sizes, several chunks a track, fixed or listed sample sizes, sync samples)
and gives codec, duration and the byte ranges of keyframes without touching the payload.

Nulls count as empty; an empty payload is one sample of spaces. The container holds no times, so equal payloads are
equal containers. Containers that are cut off or have no track give a null codec, zero samples and no keyframes; counts
in damaged tables are cut to what the tables hold and sample ranges outside the file read as far as the file goes.
Repeated rows come back as often as they occur, an empty table gives no rows, and columns other than doc_id and text are
not read, whatever their names. Durations of over 2**32 - 1 samples are written with 64 bits (version 1 boxes).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, materialize

UNIT, RATE = 192, 8000
#: A keyframe every so many samples, a chunk of so many.
KEY_EVERY, CHUNK = 16, 64
#: Containers in containers that are looked into; files need six.
DEPTH = 16
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def padded(text: bytes) -> bytes:
    """``text`` with spaces up to a positive multiple of UNIT."""
    return text + b" " * ((-len(text)) % UNIT or UNIT * (not text))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """An ISO container of ``payload``, whose length is a multiple of UNIT."""
    n, matrix = len(payload) // UNIT, struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    chunks = -(-n // CHUNK)
    head = box(b"ftyp", b"isom", struct.pack(">I", 0), b"isom")

    def moov(first: int) -> bytes:
        at = first + UNIT * CHUNK * np.arange(chunks, dtype=np.int64)
        wide = len(at) and int(at[-1]) >= 1 << 32
        runs = [(1, CHUNK, 1)] if n % CHUNK == 0 else [(1, n % CHUNK, 1)] if n < CHUNK else [(1, CHUNK, 1), (chunks, n % CHUNK, 1)]
        keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        length = n * UNIT
        long = length >= 1 << 32
        stamps = struct.pack(">QQIQ", 0, 0, RATE, length) if long else struct.pack(">IIII", 0, 0, RATE, length)
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        mdia = box(b"mdia", full(b"mdhd", stamps, struct.pack(">HH", 0x55C4, 0), version=long), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ" if long else ">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 1 << 8, 0), matrix, bytes(8), flags=7, version=long)
        mvhd = full(b"mvhd", stamps, struct.pack(">IH", 1 << 16, 1 << 8), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=long)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    body = box(b"mdat", payload)
    start = len(head) + len(moov(0)) + len(body) - len(payload)
    return head + moov(start) + body


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end of the content) of the boxes in a range; a box that goes beyond it ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            return
        yield kind, body, stop
        start = stop


def walk(data: memoryview, start: int, end: int, depth: int = 0) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start, end, depth) of all boxes in a range, those in containers after the container itself."""
    for kind, a, b in boxes(data, start, end):
        yield kind, a, b, depth
        if kind in CONTAINERS and depth < DEPTH:
            yield from walk(data, a, b, depth + 1)


NO_TRACK = {"codec": None, "timescale": 0, "duration": 0, "samples": 0, "offset": np.zeros(0, np.int64), "size": np.zeros(0, np.int64), "keyframes": np.zeros(0, np.int64)}
#: Bytes that each table needs at the least.
LEAST = {b"mdhd": 24, b"stsd": 16, b"stsz": 12, b"stsc": 8, b"stts": 8}


def tracks(media: bytes) -> list[dict]:
    """What ``demux`` tells, of each track in the order of the file; tracks without whole sample tables are left out."""
    data, parts = memoryview(media), []
    for kind, a, b, _ in walk(data, 0, len(data)):
        if kind == b"trak":
            parts.append({})
        elif parts:
            parts[-1].setdefault(kind, data[a:b])
    return [t for p in parts if (t := _track(p, len(data)))]


def _track(found: dict[bytes, memoryview], length: int) -> dict | None:
    """Samples of one track. Counts that its tables do not bear out are cut to what the tables hold, and samples of a
    fixed size to what a file of ``length`` bytes can hold, so nothing is made that is larger than the file."""
    if any(len(found.get(k, b"")) < n for k, n in LEAST.items()):
        return None
    offsets, item = (found[b"stco"], ">u4") if b"stco" in found else (found.get(b"co64", b""), ">u8")

    def column(table: memoryview, skip: int, width: int = 1, item: str = ">u4") -> np.ndarray:
        """The rows that the table declares and has room for."""
        step = np.dtype(item).itemsize * width
        if len(table) < skip:
            return np.zeros((0, width), np.int64)
        n = min(int.from_bytes(table[skip - 4 : skip], "big"), (len(table) - skip) // step)
        return np.frombuffer(table[skip : skip + n * step], item).astype(np.int64).reshape(-1, width)

    head = found[b"mdhd"]
    if head[0] == 1 and len(head) < 32:
        return None
    timescale, duration = struct.unpack_from(">IQ", head, 20) if head[0] == 1 else struct.unpack_from(">II", head, 12)
    even, n = struct.unpack_from(">II", found[b"stsz"], 4)
    chunk = column(offsets, 8, item=item)[:, 0]
    runs = column(found[b"stsc"], 8, 3)
    first, each = runs[:, 0], runs[:, 1]
    ordered = len(first) and first[0] == 1 and (np.diff(first) > 0).all()
    if not len(chunk) or not ordered:
        return None
    first, each = first[first <= len(chunk)], each[first <= len(chunk)]
    last = np.append(first[1:], len(chunk) + 1)
    timed = int(column(found[b"stts"], 8, 2)[:, 0].sum())
    held = min(int(((last - first) * each).sum()), n, timed)
    size = np.full(min(held, length // even), even, np.int64) if even else column(found[b"stsz"], 12)[:held, 0]
    of = np.repeat(np.arange(len(chunk)), _capped(np.repeat(each, last - first), len(size)))
    before = np.concatenate([[0], size.cumsum()])
    opens = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    start = np.repeat(before[opens], np.diff(np.append(opens, len(of))))
    keys = column(found[b"stss"], 8)[:, 0] - 1 if b"stss" in found else np.arange(len(of))
    keys = keys[(keys >= 0) & (keys < len(of))]
    return {"codec": bytes(found[b"stsd"][12:16]).decode("latin-1"), "timescale": timescale, "duration": duration, "samples": len(of), "offset": chunk[of] + before[: len(of)] - start, "size": size[: len(of)], "keyframes": keys}


def _capped(each: np.ndarray, most: int) -> np.ndarray:
    """Samples of each chunk until ``most`` are used up."""
    ends = np.minimum(each.cumsum(), most)
    return np.diff(ends, prepend=0)


def demux(media: bytes) -> dict:
    """codec, timescale, duration, samples, offsets and sizes of samples, keyframes (sample numbers from 0), of the first
    track that has whole tables; NO_TRACK where there is none. A box's range outside the file ends the walk there."""
    return next(iter(tracks(media)), NO_TRACK)


def payload_of(media: bytes, info: dict) -> bytes:
    """The samples in order; those that lie one after the other are read as one range."""
    offset, size = info["offset"], info["size"]
    if not len(offset):
        return b""
    opens = np.flatnonzero(np.concatenate([[True], offset[1:] != offset[:-1] + size[:-1]]))
    ends = np.append(opens[1:], len(offset)) - 1
    return b"".join(media[a:b] for a, b in zip(offset[opens].tolist(), (offset[ends] + size[ends]).tolist(), strict=True))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) with each whole text of ``docs`` (doc_id, text) in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = as_bytes(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Digests and media columns of ``media`` (doc_id, n_bytes, media): codec, duration and keyframes' byte ranges."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"]
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                info = demux(m)
                payload = payload_of(m, info)
                keys = [{"offset": int(info["offset"][k]), "length": int(info["size"][k])} for k in info["keyframes"]]
                feature = f"{info['codec']}/{info['timescale']}/{info['duration']}/{info['samples']}/{len(keys)}/{hashlib.sha256(repr([tuple(k.values()) for k in keys]).encode()).hexdigest()[:16]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, info["codec"], info["duration"] / max(info["timescale"], 1), keys))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), ranges)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset: long, length: long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every text stored in a container, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return describe(materialize(store(docs), "media"))
