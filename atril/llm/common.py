"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one chunk of documents holds before it is closed.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local
    master (tests); on a cluster nobody but this machine would see that, so there it is an error."""
    if not (base := spark.conf.get("spark.checkpoint.dir", "")):
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="atril-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/atril-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder; the application's part of that folder goes when the driver exits."""
    base = shared_dir(spark)
    if base not in _cleaned:
        _cleaned.add(base)
        atexit.register(_remove, spark, base)
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, base: str) -> None:
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark removes the shuffle files of a finished command.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, kind: str = "table", by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and lost executors cost no rows.

    The shuffle files of the write go with it, as nothing needs them any more. by: a column whose values have a folder each.
    Also gives the path, for ``forget``.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, kind)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns)), path


class Buckets:
    """A table of the warehouse in buckets of ``key``, as many as keys are dealt ways: tables that meet by this key are not
    shuffled again. It goes when the driver exits. by: a column whose values have a folder each."""

    def __init__(self, spark: SparkSession, key: str, by: str | None = None):
        self.spark, self.key, self.by, self.n, self.name = spark, key, by, dealt(spark), f"atril_{uuid.uuid4().hex}"
        atexit.register(_drop, spark, self.name)

    def append(self, df: DataFrame) -> None:
        """Add rows; dealt by the key beforehand, they add at most a file a bucket (and folder) a task."""
        was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            out = df.write.mode("append").format("parquet").option("compression", "zstd")
            (out.partitionBy(self.by) if self.by else out).bucketBy(self.n, self.key).saveAsTable(self.name)
        finally:
            self.spark.conf.set(CLEANUP, was)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def path(self) -> str:
        return self.spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").first()["data_type"]


def _drop(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def materialize(df: DataFrame, kind: str = "table", by: str | None = None) -> DataFrame:
    return written(df, kind, by)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Remove a written table, or a part of one, that nothing reads any more."""
    _remove(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not use in any case."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def dealt(spark: SparkSession) -> int:
    """How many ways keys are dealt: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def pack(array: np.ndarray) -> bytes:
    """Compress integers: bytes of equal weight lie together, which lets zstd drop the unused high ones."""
    if not len(array):
        return b""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).reshape(-1))


def unpack(blob: bytes, dtype) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def pack_ints(array: np.ndarray) -> bytes:
    """``pack`` of whole numbers from 0 on, in as many bytes as the largest needs."""
    if not len(array):
        return b""
    width = next(w for w in (1, 2, 4, 8) if int(array.max()) < 1 << 8 * w)
    return bytes([width]) + pack(array.astype(f"<u{width}"))


def unpack_ints(blob: bytes) -> np.ndarray:
    """The numbers of ``pack_ints``, as int64."""
    return unpack(blob[1:], f"<u{blob[0]}").astype(np.int64) if blob else np.zeros(0, np.int64)


class Index(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def chunked(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Lists of (id, text bytes) with about ``size`` bytes of text; a longer document has a chunk for itself."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            if rows and held + len(row[1]) > size:
                yield rows
                rows, held = [], 0
            rows.append(row)
            held += len(row[1]) + 64
    if rows:
        yield rows


def pieces_of(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Stretches of about ``size`` bytes that end at ASCII white space, so that no word is cut."""
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[start:end] if start or end < len(text) else text
        start = end


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what ``bytes.split`` splits at is just that."""
    return text.split()


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The number of ``words_of`` each text, the words of all as numbers, and the words in the order in which they come."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    ends, words = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
    kept = pc.not_equal(words, "")  # before and after white space at the ends of a text
    sizes = np.diff(np.append(0, kept.to_numpy(zero_copy_only=False).cumsum())[ends])
    coded = words.filter(kept).dictionary_encode()
    return sizes, coded.indices.to_numpy(), coded.dictionary.view(pa.binary()).to_pylist()
