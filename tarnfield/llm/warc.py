"""WARC archives: writing, reading, and revisit resolution.

Pages' headers (digest, length, id) are grouped by payload digest; the payload
of the largest id stays a response record, the others become revisit records
that name it. Archives are Spark text output, so any store that Spark writes
will do: a part file is a WARC stream under gzip. They are read back as binary
files, record by record, checking each length and digest, and revisits take
their payload's facts from the response with their digest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, lean, materialise

#: Smaller payloads are always written whole.
MIN_REVISIT = 1000
#: Payload bytes in one archive file at most, but for single larger payloads, so that a reader holds little at a time.
FILE_BYTES = 128 << 20
#: Payloads up to LEAST_CLASS bytes are the first size class; each further one goes up to CLASS_STEP times that.
LEAST_CLASS, CLASS_STEP, LAST_CLASS = 64 << 10, 8, 4
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages (id, digest, bytes, ...) -> also refers_to: the id of the response that a revisit names, else null.

    Only digests and ids are grouped, combining map-side; groups of one don't
    come back. A digest with a large share of the pages is split by adaptive
    execution.
    """
    groups = pages.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialise(groups, "warc-groups")  # so that the join's shuffles are plain ones, whose hot partitions can be split
    joined = pages.join(groups, ["digest", "bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response"))).drop("response")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends in it are escaped."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def record(revisit: Column) -> Column:
    """The text of a record of (id, url, payload, sha1 digest, refers_to), without its last line end."""
    http = F.lit(HTTP)
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = "urn:tarnfield:page:"
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{name}"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.concat(F.lit(f"<{name}"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", F.octet_length(body)),
        F.lit(CRLF),
    )
    return F.concat(head, body, F.lit(CRLF))


def prepared(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def size_class(size: Column) -> Column:
    out = F.lit(LAST_CLASS)
    for k in reversed(range(LAST_CLASS)):
        out = F.when(size <= LEAST_CLASS * CLASS_STEP**k, k).otherwise(out)
    return out


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> None:
    """Writes deduplicated archives with fresh headers: one record per row of prepared().

    Spark's writers count records, not bytes, so each size class has files of
    its own, of as many records as FILE_BYTES hold of its largest.
    """
    sized = size_class(F.col("bytes"))
    classes = sorted(r[0] for r in pages.select(sized).distinct().collect())
    linked = resolve(pages, min_bytes)
    for k in classes:
        most = max(1, FILE_BYTES // (LEAST_CLASS * CLASS_STEP**k)) if k < LAST_CLASS else 1
        records = linked.where(sized == k).select(record(F.col("refers_to").isNotNull()).alias("value"))
        records.write.mode("append").option("maxRecordsPerFile", most).text(path, compression="gzip", lineSep=CRLF)


class BadRecord(ValueError):
    """An archive that isn't what its headers say."""


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise BadRecord(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise BadRecord(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


class _Gunzip(io.RawIOBase):
    """Decompresses as it is read, members in a row included."""

    def __init__(self, data: bytes):
        self.data, self.at, self.unzip = memoryview(data), 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            if self.unzip.eof:
                rest = self.unzip.unused_data
                self.at -= len(rest)
                if self.at >= len(self.data):
                    return 0
                self.unzip = zlib.decompressobj(31)
            fed = self.unzip.unconsumed_tail or self.data[self.at : self.at + 65536]
            if not self.unzip.unconsumed_tail:
                self.at += len(fed)
            if not len(fed):
                return 0
            got = self.unzip.decompress(fed, len(out))
            if got:
                out[: len(got)] = got
                return len(got)


def _bare_sha1(value: str) -> str:
    digest = value.rpartition(":")[2]
    return digest.lower() if len(digest) == 40 else base64.b32decode(digest).hex()


def _id(value: str | None) -> int | None:
    last = (value or "").strip("<>").rpartition(":")[2]
    return int(last) if last not in ("", "null") else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows: list[list] = [[] for _ in range(6)]
            for headers, block in records(io.BufferedReader(_Gunzip(batch.column(0)[i].as_py()), 1 << 16)):
                kind, digest = headers["warc-type"], _bare_sha1(headers["warc-payload-digest"])
                payload = block.partition(b"\r\n\r\n")[2]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise BadRecord(f"record {headers.get('warc-record-id')} differs from its digest")
                for column, value in zip(rows, (_id(headers.get("warc-record-id")), kind, digest, len(payload) if kind == "response" else None, _id(headers.get("warc-refers-to")), headers.get("warc-target-uri"))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["id", "record_type", "digest", "bytes", "refers_to", "url"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, record_type, digest, bytes (null for revisits), refers_to, url."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(lean(_read), "id long, record_type string, digest string, bytes long, refers_to long, url string")


def resolved(found: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Records with each revisit's payload length taken from the response that has its digest, which must be the one that it names."""
    originals = found.where((F.col("record_type") == "response") & (F.col("bytes") >= min_bytes))
    originals = materialise(originals.groupBy("digest").agg(F.max("bytes").alias("full"), F.max("id").alias("original")), "warc-originals")
    revisits = found.where("record_type = 'revisit'").join(originals, "digest", "left")
    wrong = F.raise_error(F.concat(F.lit("a revisit names no response with its payload: "), F.coalesce("digest", F.lit("no digest"))))
    revisits = revisits.withColumns({"bytes": F.col("full"), "refers_to": F.when(F.col("refers_to") == F.col("original"), F.col("refers_to")).otherwise(wrong.cast("long"))})
    return found.where("record_type = 'response'").unionByName(revisits.select(found.columns))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Writes pages as archives under path (else in the shared folder), reads them back, one row per page.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to. Edge
    cases: null html is an empty payload; a null url has no target header; a
    null id is never the response while another row has the payload; rows that
    repeat the response's id and payload are responses too, with its record id;
    very long payloads are records in files of their own; an empty table gives
    an empty result; other columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    rows = prepared(pages, id_col, url_col, html_col)
    write_archives(rows, path, min_bytes)
    if not rows.limit(1).count():
        return spark.createDataFrame([], f"`{id_col}` long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    rows = resolved(read_archives(spark, path), min_bytes)
    return rows.select(F.col("id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
