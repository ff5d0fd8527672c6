"""WARC archives: writing, reading, and resolving revisits of equal payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, spread_join, staged, with_likely

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES, RECORDS_PER_FILE = 256 << 20, 2000  # of payload in a file, about, and at most
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column as 32 characters of base 32, upper case."""
    digest = F.sha1(payload)
    # 5 hexadecimal digits are 4 of base 32
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record for each page: ``page_id, url, payload, payload_bytes, payload_digest, record_type``."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("urn:unknown")), r"[\x00-\x20]", "%20")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    return rows.withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload")), "record_type": F.lit("response"),
    })


def resolve_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``records`` with their ``record_type`` settled and ``refers_to``, the page id of a revisit's original.

    Headers alone are shuffled by payload digest (with SHA-256 and length, as equal SHA-1 can be contrived); each
    task merges what it reads. The response with the largest page id is the original; other responses of
    ``least_bytes`` or more become revisits, and records that are revisits already are joined to it by digest.
    Only digests of several records take part in that join (:func:`spread_join`, for digests that a third of all
    records may have). Payloads are joined to the decisions only where a record may be a revisit.

    Rows that repeat a page id with its payload are all responses if it is the largest id. A null id is never an
    original unless all are null. A revisit without a response of its digest keeps a null ``refers_to``.
    """
    keys = ["payload_digest", "_sha", "payload_bytes"]
    rows = records.withColumn("_sha", F.coalesce(F.when(F.col("record_type") == "response", F.sha2("payload", 256)), F.lit("")))
    size = F.coalesce("payload_bytes", F.lit(-1))  # revisits may not have one
    headers = rows.select("page_id", "record_type", *keys[:2], size.alias("payload_bytes")).filter(f"payload_bytes < 0 OR payload_bytes >= {least_bytes}")
    headers = staged(headers, "headers")
    original = F.max(F.when(F.col("record_type") == "response", F.col("page_id")))
    counted = headers.groupBy(*keys).agg(original.alias("_original"), F.count(F.lit(1)).alias("_n"))
    # revisits have no payload to hash again: their digest finds the responses
    responses = counted.filter("_sha <> ''").groupBy("payload_digest").agg(F.max("_original").alias("_found"))
    lone = counted.filter("_sha = ''").join(responses, "payload_digest").select(*keys, F.col("_found").alias("_original"), "_n")
    groups = staged(counted.filter("_sha <> '' AND _n > 1").unionByName(lone), "groups")
    own = spread_join(headers, groups, keys, "_n", ["page_id"])
    again = (F.col("record_type") != "response") | (F.col("_original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_original")))
    revisits = staged(own.filter(again).select("page_id", *keys, "_original").distinct(), "revisits")
    same = [F.col("page_id"), F.col("payload_digest"), F.col("_sha")]
    likely = with_likely(rows, same, revisits, same, "_likely")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    alone = likely.filter("NOT _likely").select(*columns, "record_type", F.lit(None).cast("long").alias("refers_to"))
    r = revisits.select(*(F.col(c).alias(f"r_{c}") for c in ("page_id", "payload_digest", "_sha")), "_original", F.lit(True).alias("_again"))
    on = likely["page_id"].eqNullSafe(r["r_page_id"]) & (likely["payload_digest"] == r["r_payload_digest"]) & (likely["_sha"] == r["r__sha"])
    kind = F.when(F.col("_again"), "revisit").otherwise(F.col("record_type"))
    joined = likely.filter("_likely").join(r, on, "left").select(*columns, kind.alias("record_type"), F.col("_original").alias("refers_to"))
    return alone.unionByName(joined)


def record_id(page: Column, digest: Column) -> Column:
    """A record id that follows from page and payload: a UUID from their digest."""
    h = F.sha1(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str = DATE, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes resolved records as gzipped WARC 1.1 files with fresh headers; revisits have no payload. A file is one
    gzip stream of at most ``records_per_file`` records; it is read back whole, so it must stay under 2 GiB.

    A record ends with two line breaks, which Spark's text writer puts after each row.
    """
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END))).otherwise("")

    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.concat(F.encode(http, "UTF-8"), F.when(revisit, F.unhex(F.lit(""))).otherwise(F.col("payload")))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), line("WARC-Refers-To", F.when(revisit & F.col("refers_to").isNotNull(), record_id(F.col("refers_to"), F.col("payload_digest")))),
        line("WARC-Page-ID", F.col("page_id")), line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length("_block")), F.lit(END),
    )
    rows = records.withColumn("_block", block).select(F.concat(F.encode(header, "UTF-8"), F.col("_block")).cast("string").alias("value"))
    rows.write.option("lineSep", END + END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def _records(content: pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
        while first := stream.readline():
            if not first.strip():
                continue
            if not first.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {first[:80]!r}")
            headers = {}
            while (text := stream.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = text.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            block = stream.read(int(headers["content-length"]))
            if len(block) < int(headers["content-length"]):
                raise ValueError("a record is cut short")
            yield headers, block


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record: ``record_id, record_type, page_id, url, payload_bytes, payload_digest, refers_to_record``
    and, if asked for, ``payload``. Sizes and digests of responses are those of the payload that was read; one that
    differs from its header is an error. Revisits have a null size."""
    names = ["record_id", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to_record", *["payload"] * payloads]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                held = []
                for headers, block in _records(batch.column(0)[k].as_buffer()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, kind = headers.get("warc-payload-digest", "").removeprefix("sha1:"), headers["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{headers['warc-record-id']}: the payload differs from its digest")
                    page = headers.get("warc-page-id")
                    held.append((headers["warc-record-id"], kind, int(page) if page else None, headers.get("warc-target-uri"), len(payload) if kind == "response" else None, digest, headers.get("warc-refers-to"), *[payload] * payloads))
                    if len(held) == 1000:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    schema = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to_record string" + ", payload binary" * payloads
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(read, schema)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as deduplicated archives in the shared folder and reads them back, a row for each page:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A revisit's size and digest are those of
    its original's payload, found by joining records on the original's id.

    A null html is an empty payload, a null url ``urn:unknown``. An empty table writes no record and gives no rows;
    other columns are ignored. Long pages make files of fewer records.
    """
    path = shared_path(pages.sparkSession, "archives")
    mean = pages.agg(F.avg(F.octet_length(html_col))).first()[0] or 0
    write_archives(resolve_revisits(page_records(pages, id_col, url_col, html_col), least_bytes), path, records_per_file=max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / (mean + 1)))))
    records = staged(read_archives(pages.sparkSession, path), "records")
    own = records.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    originals = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"
    ).distinct()
    again = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to_record").join(originals, "refers_to_record", "left")
    return own.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
