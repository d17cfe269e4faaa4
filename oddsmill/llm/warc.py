"""WARC archives: writing, reading and transaction assembly.

Every page becomes one capture of three records: the response (or, where an
equal payload is archived already, a revisit that refers to it) and, concurrent
to it, the request and a metadata record.  Archives are gzip files in the
shared folder, written and read through Spark's own sinks and sources, so any
file system that Spark knows will do.  Assembly joins requests and metadata to
captures through their concurrent-to identifiers and gives one nested row per
capture; revisits then find the payload they refer to by record identifier.

Defined results: a null payload is empty; a null page_id or url is absent from
the records and null when read; of equal payloads the greatest page_id (then
url) is the response, null ids being least; rows repeated whole are all of the
same type; where several requests or metadata records name one capture the
least record identifier is nested and their number given; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, same, small_batches, work_path

# Fixed values of the format.
VERSION = "WARC/1.1"
BREAK = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"

_RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, fields map<string,string>, payload_bytes long, payload binary"
_NAMES = [part.strip().split(" ")[0] for part in _RECORD.replace("map<string,string>", "map").split(",")]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(kind: str, page_id: object, url: str | None, digest: str) -> str:
    name = hashlib.sha1(f"{kind}\n{page_id}\n{url}\n{digest}".encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def _clean(url: str) -> str:
    """Header values hold no white space or controls; they and % before hex digits of our own stay readable."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + BREAK.encode() + block


def capture_records(page_id: object, url: str | None, html: str | None, original: tuple | None, date: str = NO_DATE) -> list[bytes]:
    """The three records of one page, without the break after each; ``original`` is (page_id, url) of the response a revisit refers to."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base32_sha1(payload)
    own = _record_id("response" if original is None else "revisit", page_id, url, digest)
    uri = None if url is None else _clean(url)
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{BREAK}".encode()
    digests = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if original is None:
        capture = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *digests], head + payload)
    else:
        refers = _record_id("response", *original, digest)
        capture = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers), *digests], head)
    get = f"GET {uri or '/'} HTTP/1.1{BREAK}".encode("utf-8", "surrogatepass")
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", page_id, url, digest)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], get
    )
    about = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", page_id, url, digest)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], about
    )
    return [capture, request, metadata]


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE) -> None:
    """Write gzip archives; payloads of at least ``least_bytes`` that occur more than once are stored once."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    counted = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max(F.struct("id", "url")).alias("o"), F.count(F.lit(1)).alias("n"))
    shared = materialize(counted.where("n > 1").select(F.col("sha").alias("_sha"), F.col("o.id").alias("o_id"), F.col("o.url").alias("o_url"), F.lit(True).alias("many")), "warc-shared")
    joined = rows.join(shared, F.col("sha") == F.col("_sha"), "left")
    first = same([F.col("id"), F.col("url")], [F.col("o_id"), F.col("o_url")])
    joined = joined.select("id", "url", "html", (F.col("many").isNotNull() & ~first).alias("again"), "o_id", "o_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records: list[bytes] = []
            for i, url, text, again, o_id, o_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records += capture_records(i, url, text, (o_id, o_url) if again else None, date)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["value"])

    # the text sink writes the bytes of a row and the break that ends a WARC record
    records = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", BREAK).option("compression", "gzip").text(out)


def parse_archive(data: bytes, payloads: bool = True, step: int = 1 << 20) -> Iterator[tuple]:
    """Records of one archive (plain, or gzip of one or many members), read in bounded steps."""
    source = _inflated(data, step) if data[:2] == b"\x1f\x8b" else (data[i : i + step] for i in range(0, len(data), step))
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while fill(2) and held[:2] == b"\r\n":
            del held[:2]
        if not held:
            return
        seen = 0
        while (end := held.find(BREAK.encode(), max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("archive ends inside a record's header")
        lines = held[:end].decode("utf-8", "surrogatepass").split("\r\n")
        del held[: end + 4]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not fill(size):
            raise ValueError("archive ends inside a record's block")
        block = bytes(held[:size])
        del held[:size]
        yield _parsed(headers, block, payloads)


def _inflated(data: bytes, step: int) -> Iterator[bytes]:
    while data:
        inflate, tail = zlib.decompressobj(31), data
        while not inflate.eof:
            out = inflate.decompress(tail, step)
            tail = inflate.unconsumed_tail
            if out:
                yield out
            elif not (tail or inflate.eof):
                raise ValueError("archive ends inside a gzip member")
        data = inflate.unused_data.lstrip(b"\0")


def _parsed(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, fields, payload = headers.get("warc-type"), {}, None
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(BREAK.encode())[2]
    elif headers.get("content-type") == "application/warc-fields":
        pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n"))
        fields = {k.strip(): v.strip() for k, sep, v in pairs if sep}
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and payload is not None:
        digest = base32_sha1(payload)  # of what is there, not what the header claims
    size = len(payload) if kind == "response" and payload is not None else None
    return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"),
            headers.get("warc-date"), digest, list(fields.items()), size, payload if payloads else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives in a folder."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in parse_archive(content.as_py(), payloads):
                    held.append(record)
                    size += 500 + len(record[-1] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays(_columns(held), _NAMES)
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays(_columns(held), _NAMES)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary()]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture``, ``request``, ``metadata``, ``n_requests``, ``n_metadata``."""

    def concurrent(kind: str, key: str) -> DataFrame:
        own = F.struct("record_id", "target_uri", "date", "fields", "payload")
        return (
            records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
            .groupBy(F.col("concurrent_to").alias(key))
            .agg(F.min_by(own, "record_id").alias(kind), F.count(F.lit(1)).alias("n_" + ("requests" if kind == "request" else kind)))
        )

    captures = records.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("_id"),
        F.struct("record_id", "type", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "payload").alias("capture"),
    )
    joined = captures.join(concurrent("request", "_r"), F.col("_id") == F.col("_r"), "left").join(concurrent("metadata", "_m"), F.col("_id") == F.col("_m"), "left")
    zero = F.lit(0).cast("long")
    return joined.select("capture", "request", "metadata", F.coalesce("n_requests", zero).alias("n_requests"), F.coalesce("n_metadata", zero).alias("n_metadata"))


def resolved(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits get what they refer to."""
    flat = captures.select(
        F.try_element_at("metadata.fields", F.lit("page-id")).cast("long").alias("page_id"),
        F.col("capture.record_id").alias("record_id"), F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("_to"),
        F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.target_uri").alias("target_uri"),
    )
    flat = materialize(flat, "warc-captures")
    wanted = flat.where("_to is not null").select(F.col("_to").alias("_w")).distinct()
    originals = flat.where("record_type = 'response'").join(wanted, F.col("record_id") == F.col("_w"), "left_semi")
    originals = originals.groupBy(F.col("record_id").alias("_o")).agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"))
    originals = materialize(originals, "warc-originals")
    out = flat.join(originals, F.col("_to") == F.col("_o"), "left")
    return out.select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"), "record_id", "target_uri"
    )


def op6_warc(spark, sf_dir: str) -> DataFrame:
    out = work_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    records = materialize(read_archives(spark, out, payloads=False), "warc-records")
    return resolved(assemble(records)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), parts AS (
  SELECT hex, list_transform(range(0, 8), lambda k: CAST('0x' || substr(hex, CAST(5 * k + 1 AS INT), 5) AS BIGINT)) AS v
  FROM (SELECT DISTINCT hex FROM p)
), digests AS (
  SELECT hex, array_to_string(list_transform(v, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x // 32768) % 32 + 1 AS INT), 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x // 1024) % 32 + 1 AS INT), 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x // 32) % 32 + 1 AS INT), 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x % 32 + 1 AS INT), 1)), '') AS payload_digest
  FROM parts
), g AS (
  SELECT page_id, hex, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g JOIN digests ON digests.hex = g.hex
"""
