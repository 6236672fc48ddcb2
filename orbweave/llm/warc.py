"""Content-addressed archive of WARC records.

``records`` builds a WARC/1.1 record for each page: header block and payload. ``archive`` stores them as
two tables: payload bytes once for each SHA-256 digest, and the exact header block of every record with
the digest of its payload. ``restore`` joins the two, checks each payload against its digest and gives the
records back byte by byte. ``write_files`` and ``read_files`` exchange WARC files, one gzip member for each
record; payloads of any bytes come through.

Of records with equal payloads of ``LEAST`` bytes or more the one of smallest page_id is a response, the
others are revisits that refer to it; smaller payloads are all responses.

Defined cases: null html is an empty payload; a null url has no target line; repeated rows with the page_id
of the response are responses too; a null page_id is a response only if no other record has the payload;
an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

LEAST = 100
DATE = "1970-01-01T00:00:00Z"  #: pages carry no date of their own
URN = "urn:page:"


def _line(name: str, value) -> F.Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, header, digest, payload): a WARC record for each page; the record is header followed by payload."""
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.length("payload"))
    # only digests are shuffled to find the first of equal payloads
    first = rows.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL").select("digest", "first")
    rows = rows.join(written(first, "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{URN}"), F.col("first").cast("string"), F.lit(">")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.col("n").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select("page_id", F.encode(header, "UTF-8").alias("header"), "digest", "payload")


def archive(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored tables: heads (page_id, header, digest) and payloads (digest, payload), each digest once."""
    payloads = written(rows.select("digest", "payload").dropDuplicates(["digest"]), "payloads")
    heads = written(rows.select("page_id", "header", "digest"), "heads")
    return heads, payloads


def restore(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, record): every original record. A payload that doesn't match its digest fails the query."""
    checked = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest"))).alias("payload"))
    return heads.join(checked, "digest").select("page_id", F.concat("header", "payload").alias("record"))


def parsed(restored: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri: read from the bytes of each record."""
    # a header has no empty line of its own, so the first one ends it; Latin-1 keeps places equal to bytes
    rows = restored.withColumn("end", F.instr(F.decode("record", "ISO-8859-1"), "\r\n\r\n")).select("page_id", F.decode(F.expr("substring(record, 1, end + 1)"), "UTF-8").alias("head"), F.expr("substring(record, end + 4)").alias("payload"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))
    refers = F.regexp_extract(F.coalesce(field("WARC-Refers-To"), F.lit("")), rf"{URN}(-?\d+)", 1)
    return rows.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), field("WARC-Type").alias("record_type"), F.nullif(refers, F.lit("")).cast("long").alias("refers_to"), field("WARC-Target-URI").alias("target_uri"))


def write_files(restored: DataFrame, path: str, file_bytes: int = 256 << 20) -> int:
    """WARC files (a gzip member for each record) of about ``file_bytes`` bytes; the number of records.

    ``path`` is a folder or URI that every executor can write. Tasks write under ``_part`` names of their own; only
    files of tasks that came through get their final names, so lost or repeated tasks leave no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, int]] = []
        out, size, n = None, 0, 0
        fs, base = _files(path)
        for b in batches:
            for record in b.column(0).to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, n = fs.open_output_stream(f"{base}/_part/{name}", compression=None), 0, 0
                member = gzip.compress(record + b"\r\n\r\n", mtime=0)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    made.append((name, n))
                    out = None
        if out is not None:
            out.close()
            made.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["name", "n"])

    fs, base = _files(path)
    fs.create_dir(f"{base}/_part", recursive=True)
    made = restored.select("record").mapInArrow(run, "name string, n long").collect()
    for m in made:
        fs.move(f"{base}/_part/{m.name}", f"{base}/{m.name}")
    fs.delete_dir(f"{base}/_part")
    return sum(m.n for m in made)


def _files(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def _inflated(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """Plain bytes of gzip members one after the other (or of a plain file), ``most`` at a time."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + most] for i in range(0, len(data), most))
        return
    view = memoryview(data)
    while len(view) and bytes(view[:2]) == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        feed = view[:most]
        view = view[most:]
        while True:
            got = z.decompress(feed, most)
            if got:
                yield got
            if z.eof:
                view = _from(view, z.unused_data)
                break
            feed = z.unconsumed_tail
            if not feed:
                if not len(view):
                    return
                feed, view = view[:most], view[most:]


def _from(view: memoryview, unused: bytes) -> memoryview:
    """``view`` preceded by the ``unused`` bytes, which stand right before it in the same buffer."""
    whole = memoryview(view.obj)
    return whole[len(whole) - len(view) - len(unused) :]


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header block, payload) of each record by its Content-Length; one record is held at a time."""
    held = bytearray()

    def fill(enough) -> bool:
        while not enough():
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        if not fill(lambda: held.find(b"WARC/1.") >= 0):
            return
        del held[: held.find(b"WARC/1.")]
        if not fill(lambda: held.find(b"\r\n\r\n") >= 0):
            return
        body = held.find(b"\r\n\r\n") + 4
        header = bytes(held[:body])
        length = re.search(rb"(?im)^Content-Length:\s*(\d+)", header)
        size = int(length[1]) if length else 0
        fill(lambda: len(held) >= body + size)
        payload = bytes(held[body : body + size])
        if len(payload) < size:
            raise ValueError("WARC record cut short")
        del held[: body + size]
        yield header, payload


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, digest, payload) of the records in WARC files, by their own Content-Length; the digest is that of the payload.

    A task holds a file as it is stored (``write_files`` bounds it) and one record of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                out, size = [], 0
                for header, payload in _records(_inflated(data.as_py())):
                    ident = re.search(rb"(?im)^WARC-Record-ID:\s*<?[^\r\n>]*?(-?\d+)>?\r", header)
                    out.append((int(ident[1]) if ident else None, header, hashlib.sha256(payload).hexdigest(), payload))
                    size += len(payload)
                    if len(out) >= 1000 or size > 16 << 20:
                        yield _batch(out)
                        out, size = [], 0
                yield _batch(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*warc*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, header binary, digest string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["page_id", "header", "digest", "payload"])
