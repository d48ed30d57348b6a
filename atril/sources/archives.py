"""Members of tar.gz archives, the first of each name in tab-separated tables, and results laid out in folders."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import lines

#: Names that a scan may be asked for: they travel with the task. Take all members and join for more.
MAX_NAMES = 100_000
#: Bytes of members that are handed over at once.
BATCH_BYTES = 16 << 20


def read_tar(spark: SparkSession, path: str, wanted: set[str] | None = None) -> DataFrame:
    """(archive, name, content) of the files in each archive, by base name, the first of a name.

    An archive is unpacked as a stream and left once all wanted names are found. One task an archive, which may have
    2 GB (the limit of a binary value).
    """
    if wanted is not None and len(wanted) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen, rows, held = set(), [], 0
                with tarfile.open(fileobj=io.BytesIO(content.as_buffer()), mode="r|*") as tar:
                    for member in tar:
                        name = member.name.rsplit("/", 1)[-1]
                        if not member.isfile() or name in seen or (wanted is not None and name not in wanted):
                            continue
                        seen.add(name)
                        rows.append((archive, name, tar.extractfile(member).read()))
                        held += len(rows[-1][2])
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                        if wanted is not None and len(seen) == len(wanted):
                            break
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "name", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, content binary")


def first_tsv(spark: SparkSession, path: str, key: int, value: int) -> DataFrame:
    """(key, value): two fields, counted from 0, of tab-separated lines without quoting; the first line of a key counts
    and lines with fewer fields are left out."""
    cells = F.split("value", "\t")
    rows = lines(spark, path).where(F.size(cells) > max(key, value))
    return rows.groupBy(cells[key].alias("key")).agg(F.min_by(cells[value], F.struct("file", "line_no")).alias("value"))


def discovered(spark: SparkSession, path: str, subsets: list[str]) -> DataFrame:
    """(model, subset, line_no, value): lines of ``<model>/<subset>.jsonl`` below ``path``, of the named subsets."""
    found = lines(spark, f"{path.rstrip('/')}/*/*.jsonl")
    part = lambda k: F.regexp_extract("file", r"([^/]+)/([^/]+)\.jsonl$", k)
    return found.select(part(1).alias("model"), part(2).alias("subset"), "line_no", "value").where(F.col("subset").isin(subsets))


def run_infos(spark: SparkSession, path: str, known: tuple[str, ...] = ()) -> dict[str, dict]:
    """What the ``*.run.json`` files of each model folder tell: label and model_id of the first file, runner of the last
    file that names one. Files that are no JSON objects are passed over; a known model is its own runner."""
    files = spark.read.text(f"{path.rstrip('/')}/*/*.run.json", wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    out: dict[str, dict] = {}
    for r in files.orderBy("file").toLocalIterator():  # a few small files a model
        model = r["file"].rsplit("/", 2)[-2]
        try:
            told = json.loads(r["value"])
        except ValueError:
            continue
        if not isinstance(told, dict):
            continue
        info = out.setdefault(model, {"type": "local-run", "runner": None})
        info.setdefault("label", told.get("label"))
        info.setdefault("model_id", told.get("model_id"))
        info["runner"] = model if model in known else told.get("model") or info["runner"]
    return out
