"""WARC archives, index first.

Writing gives archives of gzip members, one a record, and an index of offset, length, URL and digest per record.
Reading takes the selected index rows, deals them by archive and stretch, sorts them by offset and joins neighbouring
byte ranges into single reads.

A response's block is an HTTP message, as readers of ``response`` records expect: a status line, two header lines and the
html, which alone is the payload that digests and lengths are of. Each archive begins with a ``warcinfo`` record. Record
ids are made of page, url and payload and of the place in the archive, so repeated rows have their own.

Of records with equal payloads of at least ``REVISIT_BYTES``, that with the largest ``page_id`` is the response and
the others revisit it. A null id is smaller than any other. Rows that repeat the largest id are all responses. Null
html is an empty payload; a null URL leaves its header out, and white space in a URL is percent-encoded. Very long pages
are whole records. An empty table gives no archives and no rows; other columns are not read, whatever their names.

Archives are named by task attempt and the index only holds what a committed attempt wrote, so a repeated or lost
task leaves at worst an archive that nothing points to. They go to the shared folder by ``pyarrow.fs``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, dealt, materialize, scratch

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
#: Ranges at most so far apart are read as one, up to so many bytes a read; a reader takes such stretches of an archive.
GAP, READ, STRETCH = 1 << 16, 8 << 20, 32 << 20
INDEX = "page_id long, file string, offset long, length long, url string, digest string"


def filesystem(uri: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^file:/*", "file:///", uri))


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _member(lines: list[str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    """The first record of an archive."""
    lines = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(hashlib.md5(name.encode()).hexdigest())}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(lines, b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """One WARC/1.1 record of a page. A revisit has the head of the message but no payload; the full length is in an extension field."""
    block = HTTP % len(payload) + (b"" if revisit else payload)
    own = uuid.UUID(hashlib.md5(f"{page_id}\n{url}\n{digest}\n{place}".encode()).hexdigest())
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page: {page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    return _member(lines, block)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record: of an HTTP message, what follows its head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if headers["Content-Type"].startswith("application/http") else block


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to, revisit. Only digests that occur twice or more take part in the join."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"), F.length(body).alias("n"))
    large = rows.where(f"n >= {REVISIT_BYTES}").groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    copies = materialize(large.where("copies > 1").select("digest", "refers_to"), "copies").withColumnRenamed("digest", "of")
    key = F.when(F.col("n") >= REVISIT_BYTES, F.col("digest"))
    met = rows.withColumn("large", key).join(copies, F.col("large") == F.col("of"), "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return met.select("page_id", "url", "html", "digest", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def packed(member: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(member) + packer.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives to ``folder``; the index, a written table. pages: what ``with_revisits`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for b in batches:
                rows, ids, urls = [], b.column(0).to_pylist(), b.column(1).to_pylist()
                for page_id, url, html, digest, refers_to, revisit in zip(ids, urls, as_bytes(b.column(2)), *(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                    if out is None:
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(first := packed(warcinfo(name)))
                        at = len(first)
                    member = packed(record(page_id, url, html, digest, refers_to, revisit, f"{name}:{at}"))
                    out.write(member)
                    rows.append((page_id, name, at, len(member), url, digest))
                    at += len(member)
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "file", "offset", "length", "url", "digest"])
        finally:
            if out:
                out.close()

    return materialize(pages.mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, members) of reads that cover the sorted (file, offset, length)."""
    file, start, end, members = None, 0, 0, []
    for f, at, n in rows:
        if members and (f != file or at - end > GAP or at + n - start > READ):
            yield file, start, end, members
            members = []
        if not members:
            file, start, end = f, at, at
        members.append((at, n))
        end = max(end, at + n)
    if members:
        yield file, start, end, members


def read(index: DataFrame, folder: str) -> DataFrame:
    """Records of the selected ``index`` rows: page_id, record_type, refers_to, url, payload_bytes, payload_digest, payload (null for revisits).

    A response's length and digest are taken from its payload, a revisit's from its fields.
    """
    spark = index.sparkSession
    stretch = F.floor(F.col("offset") / STRETCH)
    dealt_out = index.select("file", "offset", "length", stretch.alias("stretch")).repartition(dealt(spark), "file", "stretch").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        for file, start, end, members in ranges(rows):
            with system.open_input_file(f"{path}/{file}") as source:
                data = source.read_at(end - start, start)
            out = []
            for at, n in members:
                headers, block = parse(zlib.decompress(data[at - start : at - start + n], 31))
                number = lambda s: int(s) if s != "None" else None
                revisit = headers["WARC-Type"] == "revisit"
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(block).hexdigest()
                if digest != headers["WARC-Payload-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"payload of page {headers['X-Page']} is damaged")
                out.append((number(headers["X-Page"]), headers["WARC-Type"], number(headers["X-Refers-To-Page"]) if revisit else None, headers.get("WARC-Target-URI"), int(headers["X-Payload-Length"]) if revisit else len(block), digest, None if revisit else block))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload"])

    return dealt_out.mapInArrow(run, "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every page written and read back."""
    folder = scratch(spark, "warc")
    index = write(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
best AS (SELECT payload_digest, max(page_id) AS best FROM rows WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM rows LEFT JOIN best USING (payload_digest)
"""
