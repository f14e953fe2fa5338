"""WARC archives of pages: monolithic gzip files, their normaliser with a sidecar offset index, and a reader.

Writing is a Spark text sink: each record is one row, the separator between rows is the CRLF CRLF that ends a record,
and the sink's gzip codec makes each file one monolithic gzip stream. The normaliser inflates such a stream once, cuts it
into records by Content-Length, writes every record as its own gzip member and, beside the archive, an index with offset,
length, type and id of each member. The reader goes by that index: it inflates single members, never a whole file.

Payloads are equal if their SHA-256 and sizes are; SHA-1, which can be made to collide, is only what records carry. Of
records with equal payloads of at least MIN_REVISIT bytes, the one with the largest page_id is the response; the others
are revisits, which keep the digest and the HTTP header but no payload. Names of archives are unique to an attempt of a
task and are listed in a manifest that Spark commits, so a task that runs twice leaves nothing that is read.

Cases: null html is an empty payload, a null url is about:blank, control characters and blanks in a url are percent-coded.
A row without page_id is a response and refers to nothing. Rows that repeat a page_id with equal html have one type.
Other columns are not read. A digest that doesn't fit its payload raises ValueError on reading.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.common import fresh_path, materialize, read_table, tidy

MIN_REVISIT = 1000
RECORDS_PER_FILE = 5000
END = b"\r\n\r\n"
STEP = 1 << 18


def _payload(html: Column) -> Column:
    """What tells payloads apart."""
    return F.concat(F.sha2(html, 256), F.lit(":"), F.octet_length(html).cast("string"))


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, payload, refers_to) of the pages that become revisits."""
    html = F.coalesce("html", F.lit(""))
    sums = pages.filter(F.octet_length(html) >= min_bytes).select(F.col("page_id").cast("long").alias("page_id"), _payload(html).alias("payload"))
    sums = materialize(sums, "payloads")
    groups = sums.groupBy("payload").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = sums.join(materialize(groups.drop("n"), "groups"), "payload").filter("page_id < refers_to")
    return materialize(out.select("page_id", "payload", "refers_to").distinct(), "revisits")


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Column record: each page as a WARC record without its closing CRLF CRLF."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), _payload(html).alias("payload")
    )
    rows = rows.join(revisits(pages, min_bytes), ["page_id", "payload"], "left")
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length("html"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            again,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
                F.col("refers_to").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block),
        F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write_monolithic(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of at most per_file records, each one gzip stream."""
    writer = records(pages).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file)
    writer.text(path)


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


class Records:
    """Whole records of an inflated stream that arrives in pieces."""

    def __init__(self):
        self.held, self.need = bytearray(), 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece
        at = 0
        while len(self.held) - at >= self.need:
            end = self.held.find(END, at)
            if end < 0:
                self.need = 0
                break
            head = headers(bytes(self.held[at:end]))
            size = end - at + len(END) + int(head["content-length"]) + len(END)
            if len(self.held) - at < size:
                self.need = size
                break
            yield head, bytes(self.held[at : at + size])
            at += size
            self.need = 0
        del self.held[:at]

    def close(self) -> None:
        if self.held.strip(b"\r\n"):
            raise ValueError("the archive ends within a record")


def inflate(stream, step: int = STEP) -> Iterator[bytes]:
    """The bytes of a gzip stream, whether of one member or of several."""
    engine = zlib.decompressobj(31)
    while piece := stream.read(step):
        while piece:
            yield engine.decompress(piece)
            piece = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def normalise(stream, archive, index) -> int:
    """Copy the records of a monolithic stream into members of their own; returns how many there are."""
    parser, offset, n = Records(), 0, 0
    for piece in inflate(stream):
        for head, raw in parser.feed(piece):
            engine = zlib.compressobj(5, zlib.DEFLATED, 31)
            member = engine.compress(raw) + engine.flush()
            archive.write(member)
            index.write((json.dumps([offset, len(member), head["warc-type"], head["warc-record-id"]]) + "\n").encode())
            offset += len(member)
            n += 1
    parser.close()
    return n


def _normaliser(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, at = pafs.FileSystem.from_uri(path)
                name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                with source.open_input_stream(at, compression=None) as stream, fs.open_output_stream(name, compression=None) as archive, fs.open_output_stream(f"{name}.idx", compression=None) as index:
                    n = normalise(stream, archive, index)
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    return tidy(run)


def read_record(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of one record; the digest is verified."""
    end = raw.index(END)
    head = headers(raw[:end])
    block = raw[end + len(END) : end + len(END) + int(head["content-length"])]
    http_end = block.index(END)
    http, payload = headers(block[:http_end]), block[http_end + len(END) :]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {head['warc-record-id']} doesn't fit its digest")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    return {
        "page_id": number(head["warc-record-id"]),
        "payload_bytes": len(payload) if head["warc-type"] == "response" else int(http["content-length"]),
        "payload_digest": digest,
        "record_type": head["warc-type"],
        "refers_to": number(head.get("warc-refers-to", "")),
    }


_RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with fs.open_input_stream(f"{name}.idx", compression=None) as f:
                    index = [json.loads(line) for line in f.read().decode().splitlines()]
                with fs.open_input_file(name) as archive:
                    for i in range(0, len(index), 1000):
                        rows = []
                        for offset, length, *_ in index[i : i + 1000]:
                            archive.seek(offset)
                            rows.append(read_record(zlib.decompress(archive.read(length), 31)))
                        yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)

    return tidy(run)


def normalised_archives(spark: SparkSession, monolithic: str, folder: str) -> DataFrame:
    """(archive, records) of the normalised archives that `folder` gets, one for each file of `monolithic`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(monolithic).select("path")
    return materialize(files.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(_normaliser(folder), "archive string, records long"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in a manifest, each read through the sidecar index."""
    spread = manifest.select("archive").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, folder = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    write_monolithic(read_table(spark, sf_dir, "pages"), raw)
    return read_archives(normalised_archives(spark, raw, folder), folder)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN b >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY d) END AS top FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM q
"""
