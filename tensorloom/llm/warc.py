"""WARC archives: monolithic capture, and a normaliser with one gzip member per record.

Capture writes records as text lines that Spark's text writer joins by the record
separator and compresses as one gzip stream per file, with its commit protocol. The
normaliser inflates each such file once, as a stream, rewrites every record as its own
gzip member and writes a sidecar index of offsets, so a reader can fetch single records.

Archives live in the shared folder and are opened with pyarrow's file systems, which know
``file``, ``hdfs`` and object stores; a task writes under a name of its own and renames it
when complete, so retries leave whole files only.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import stored, text_of
from tensorloom.session import scratch_path

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time

INDEX = (
    "archive string, offset long, length long, record_type string, record_id string, "
    "payload_bytes long, payload_digest string"
)


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are exactly 32 groups of five."""
    hexed = F.sha1(text)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for at in range(0, 40, 5):  # 5 hex digits are 20 bits, 4 letters
        block = F.conv(F.substring(hexed, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(letters), F.shiftright(block, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def deduplicated(pages: DataFrame, least_bytes: int = 0, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, html, bytes, digest, refers_to): revisits refer to the largest page id of their payload.

    Payloads under ``least_bytes`` are all responses. Null html is empty.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html")))
    many = rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = stored(many.select("digest", "last"), "warc-copies")
    again = (F.col("bytes") >= least_bytes) & (F.col("page_id") != F.col("last"))
    return rows.join(many, "digest", "left").withColumn("refers_to", F.when(again, F.col("last"))).drop("last")


def record_text(response: Column | None = None) -> Column:
    """A WARC record, without the separator after it, from the columns of :func:`deduplicated`."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")  # a header is one line
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _urn("page_id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, line("WARC-Refers-To", _urn("refers_to"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block)


def _urn(column: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))


def write_monolithic(pages: DataFrame, path: str, *, records_per_file: int = 20_000, **columns) -> None:
    """Archives of one gzip stream each below ``path``."""
    rows = deduplicated(pages, **columns).select(record_text().alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def inflate(raw: BinaryIO) -> Iterator[bytes]:
    """Inflated chunks of a gzip file, of bounded size, whatever the number of its members.

    A file that ends within a member, its checksum included, is an error.
    """
    stream, within = zlib.decompressobj(31), False
    while chunk := raw.read(CHUNK):
        while chunk:
            within = True
            yield stream.decompress(chunk, CHUNK)
            chunk = stream.unconsumed_tail
            if stream.eof:
                chunk, stream, within = stream.unused_data, zlib.decompressobj(31), False
    if within:
        raise ValueError("archive ends within a gzip member")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, separators included, cut by their Content-Length."""
    held, start = bytearray(), 0

    def need(stop: int) -> None:
        for chunk in chunks:
            held.extend(chunk)
            if len(held) >= stop:
                return
        raise ValueError("archive ends within a record")

    while True:
        del held[:start]
        start = 0
        if not held:
            chunk = next(chunks, None)
            if chunk is None:
                return
            held.extend(chunk)
            continue
        while (edge := held.find(END.encode())) < 0:
            need(len(held) + 1)
        stop = edge + 4 + int(headers(bytes(held[:edge]))["Content-Length"]) + len(END)
        if len(held) < stop:
            need(stop)
        yield bytes(held[:stop])
        start = stop


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive of ``source`` with one gzip member per record; returns the sidecar index.

    For ``name.txt.gz`` it writes ``name.warc.gz`` and ``name.idx`` (JSON lines) into ``target``.
    One task handles one archive and holds one record at a time.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = _rewrite(path, target)
                columns = list(zip(*rows, strict=True))
                if columns:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in INDEX.split(", ")]
                    )

    return names.mapInArrow(rewrite, INDEX)


def _rewrite(path: str, target: str) -> list[tuple]:
    system, place = _open(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))
    out_system, folder = _open(target)
    out_system.create_dir(folder, recursive=True)
    name = place.rsplit("/", 1)[-1].split(".")[0]
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    archive, rows, offset = f"{folder}/{name}.warc.gz", [], 0
    with system.open_input_stream(place, compression=None) as raw, out_system.open_output_stream(f"{own}.warc", compression=None) as out:
        for record in records(inflate(raw)):
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = squeeze.compress(record) + squeeze.flush()
            out.write(member)
            head = headers(record[: record.index(END.encode())])
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            rows.append((archive, offset, len(member), head["WARC-Type"], head["WARC-Record-ID"], int(head["X-Payload-Length"]), digest))
            offset += len(member)
    with out_system.open_output_stream(f"{own}.idx", compression=None) as out:
        for r in rows:
            out.write((json.dumps({"offset": r[1], "length": r[2], "type": r[3], "id": r[4], "digest": r[6]}) + "\n").encode())
    out_system.move(f"{own}.warc", archive)
    out_system.move(f"{own}.idx", f"{folder}/{name}.idx")
    return rows


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(index: DataFrame, target: str) -> DataFrame:
    """Fetch every indexed record by its offset and parse it: rows as ``READ``.

    Digest and size of a response are computed from its payload; those of a revisit, which
    carries no payload, are what its headers say.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(target)
        for batch in batches:
            out, name, raw = [], None, None
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if archive != name:
                    name, raw = archive, system.open_input_file(archive)
                raw.seek(offset)
                out.append(parse_record(zlib.decompress(raw.read(length), 31)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in READ.split(", ")])

    return index.select("archive", "offset", "length").mapInArrow(read, READ)


def parse_record(record: bytes) -> tuple:
    edge = record.index(END.encode())
    head = headers(record[:edge])
    block = record[edge + 4 : edge + 4 + int(head["Content-Length"])]
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if len(urn) > len("<urn:page:>") else None
    page, kind = number(head["WARC-Record-ID"]), head["WARC-Type"]
    if kind == "revisit":
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        return page, int(head["X-Payload-Length"]), digest, kind, number(head["WARC-Refers-To"])
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    return page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, None


def archive_pages(pages: DataFrame, *, least_bytes: int = 0, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Capture all pages, normalise the archives and read them back: one row per page, see ``READ``.

    An empty table gives no rows. Null html is an empty payload; null ids and repeated
    rows are kept: among equal payloads every row with the largest id is a response, and
    a row with a null id counts as one too. Other columns are ignored.
    """
    spark = pages.sparkSession
    raw, normal = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    if "://" not in normal:
        normal = "file://" + normal.removeprefix("file:")
    write_monolithic(pages, raw, least_bytes=least_bytes, id_col=id_col, url_col=url_col, html_col=html_col)
    index = stored(normalise(spark, raw, normal), "warc-index")
    return read_archives(index, normal)
