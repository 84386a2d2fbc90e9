"""WARC archives with revisit records for payloads that occur again.

Headers (page, payload digest) are shuffled by digest to find each payload's original, the
smallest page id, and joined back to the revisits; payloads are never shuffled by
digest, so a payload that a third of all pages share burdens no task. Records get fresh
headers: an id of page, digest and, where both occur again, the row; the time of writing; and a
revisit's references to its original. Archives are written by Spark's text writer with the record separator as
line end, gzip-compressed, about FILE_BYTES of records at most to a file, which commits whole tasks
only. The reader goes through Content-Length, accepts any gzip members or plain files, and joins
only revisits, each to the record that it refers to.

Defined results: a null page is an empty payload, a null address leaves out its header. Rows that repeat the smallest page id of
a payload are all responses; a null page id is never an original unless a payload has
no other, and never revisits. One page id with several payloads is several pages. Extra columns are not read; empty
tables give empty archives. Rows are told apart by their place in the input, which a scan repeats; an input
that would not (a shuffle's output that is computed anew) should be written first.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.storage import prepare, written

#: A file is read as a whole, compressed, by one task.
FILE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_RECORD = "record_id string, record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to_id string, payload string"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a payload in upper-case base 32 (five hex digits are four letters)."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*quads)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
        F.lit(">")
    )


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, original, original_url, again) for pages whose payload has a smaller page id, its original,
    and for those that occur several times with one payload, again being the first such row.

    pages: page_id, url, payload, row. Payloads under min_bytes bytes have no original.
    """
    headers = pages.where("page_id is not null").select(
        "page_id", "url", "row", base32_sha1(F.col("payload")).alias("digest"), (F.octet_length("payload") >= min_bytes).alias("large")
    )
    each = headers.groupBy("page_id", "digest", "large").agg(
        F.min("url").alias("url"), F.min("row").alias("first"), F.count("*").alias("n")
    )
    first = each.where("large").groupBy("digest").agg(
        F.min("page_id").alias("original"), F.max("page_id").alias("last")
    ).where("original < last").select("digest", "original")
    revisits = each.where("large").join(first, "digest").where("page_id > original").select("page_id", "digest", "original")
    urls = each.select(F.col("page_id").alias("original"), "digest", F.col("url").alias("original_url"))
    again = each.where("n > 1").select("page_id", "digest", F.col("first").alias("again"))
    return revisits.join(urls, ["original", "digest"], "left").join(again, ["page_id", "digest"], "full_outer").select(
        "page_id", "digest", "original", "original_url", "again"
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; a header's value is one line."""
    return F.coalesce(
        F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", ""), F.lit("\r\n")), F.lit("")
    )


def records(pages: DataFrame, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """One column, `value`: each page's whole record without its final separator. pages: page_id, url, payload; date is now unless given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.withColumn("row", F.monotonically_increasing_id())
    p = pages.withColumn("digest", base32_sha1(F.col("payload"))).join(resolve_revisits(pages, min_bytes), ["page_id", "digest"], "left")
    plain = F.when(F.col("page_id").isNull() | (F.col("again") < F.col("row")), F.col("row"))  # null for the record that others refer to
    own = F.when(plain.isNull(), record_id(F.col("page_id"), F.col("digest"))).otherwise(
        record_id(F.col("page_id"), F.col("digest"), plain)
    )
    again = F.col("original").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"),
        F.lit(_END)
    )
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", own),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(again, record_id(F.col("original"), F.col("digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(again, F.col("original_url"))),
        _line("WARC-Refers-To-Date", F.when(again, F.lit(date))),
        _line("X-Page-Id", F.col("page_id")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "),
    )
    return p.select(F.concat(head, F.octet_length(block).cast("string"), F.lit(_END), block).alias("value"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0
) -> None:
    """Writes a deduplicated archive of pages to the folder path."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload")
    )
    mean = rows.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    most = max(1, int(FILE_BYTES / (mean + 1024)))
    records(rows, min_bytes).write.option("compression", "gzip").option("lineSep", _END).option("maxRecordsPerFile", most).text(path)


class _Stream:
    """Bytes of a plain or gzip-compressed archive, decompressed as they are asked for."""

    def __init__(self, raw):
        self.raw, self.at, self.held = memoryview(raw), 0, bytearray()
        self.gzip = bytes(self.raw[:2]) == b"\x1f\x8b"
        self.codec = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        chunk = self.raw[self.at : self.at + (1 << 16)]
        self.at += len(chunk)
        if not self.gzip:
            self.held += chunk
            return True
        while len(chunk):
            self.held += self.codec.decompress(chunk)
            chunk = self.codec.unused_data if self.codec.eof else b""
            if self.codec.eof:
                self.codec = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("a record is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(raw):
    """(headers with lower-case names, block) of every record of an archive."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record has no end")
        yield headers, block


def _read(with_payload: bool):
    def rows(raw):
        for headers, block in parse(raw):
            payload = block.partition(b"\r\n\r\n")[2]
            digest = headers.get("warc-payload-digest", "").partition(":")[2]
            response = headers["warc-type"] == "response"
            if response and digest and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                raise ValueError(f"the payload of {headers['warc-record-id']} does not match its digest")
            page = headers.get("x-page-id")
            yield headers["warc-record-id"], headers["warc-type"], int(page) if page else None, headers.get("warc-target-uri"), digest, len(payload) if response else None, headers.get("warc-refers-to"), payload.decode("utf-8", "replace") if with_payload and response else None

    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in _RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                held = []
                for row in rows(raw.as_buffer()):
                    held.append(row)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in the folder; a revisit gets its original's payload_bytes,
    refers_to (the original's page id) and, if asked for, payload."""
    prepare(spark)
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read(with_payload), _RECORD)
    if not with_payload:
        found = written(found, "records")
    ours = F.col("record_type") == "response"
    first = found.where(ours).select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"),
        F.col("payload").alias("o_payload")
    )
    again = found.where(~ours).join(first, "refers_to_id", "left")
    shown = ["record_id", "record_type", "page_id", "target_uri", "payload_digest"]
    plain = found.where(ours).select(*shown, "payload_bytes", F.lit(None).cast("long").alias("refers_to"), "payload")
    out = plain.union(again.select(*shown, F.col("o_bytes"), F.col("o_page"), F.col("o_payload")))
    return out if with_payload else out.drop("payload")
