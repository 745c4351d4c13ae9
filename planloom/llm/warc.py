"""WARC archives: writing captures, reading records, and assembling transactions.

Writing: every page becomes a request, a response (or a revisit of an equal payload) and a metadata record. A record ends
with two line ends, so Spark's own text writer with that separator writes valid archives, gzipped, into the shared
folder. Pages of over LARGE bytes get archives of their own and others share one with up to RECORDS_PER_FILE records, so
that an archive holds a gigabyte at most, a single larger page apart. Of pages with equal payloads of at least MIN_REVISIT bytes the one with the
smallest id is the response and the others revisit it. Digests are grouped with partial aggregation in a table without
payloads, and the revisits are joined to the pages by the page's id, so that a payload that a third of the pages share
makes no hot task.

Reading: each archive is one row of Spark's binary reader. It is unzipped as a stream and parsed by Content-Length, a
record at a time.

Assembly: all records are dealt once by the identifier of their capture, which is WARC-Concurrent-To of request and
metadata records and the response's or revisit's own identifier, and each capture is one nested row.

Defined cases: a null payload is empty; a null url writes no WARC-Target-URI, and spaces and control characters of a url
are written as %20; pages with a null id are responses, each for itself; rows that repeat a page's id are captures of
their own, told apart by an ordinal in order of url and payload (rows with a null id by url and payload themselves, so
that they never meet); payloads of any length are written and read whole; a request or metadata record without its response is
left out of the assembly, a response without them has empty lists; an empty table writes an empty archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.llm import common

MIN_REVISIT = 100
RECORDS_PER_FILE = 1000
LARGE = 1 << 20
DATE = "2020-01-01T00:00:00Z"
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of blocks that a batch of parsed records carries at most, a single larger record apart.
BATCH_BYTES = 16 << 20
#: Bytes of an archive that are unzipped at once.
PART_BYTES = 4 << 20


def _lines(*lines: Column | str) -> Column:
    """Header lines, each with its line end; a null line is left out."""
    return F.concat(*[F.coalesce(F.concat(x if isinstance(x, Column) else F.lit(x), F.lit(END)), F.lit("")) for x in lines])


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _record_id(kind: str, page_id: Column, ordinal: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), page_id.cast("string"), ordinal.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str | Column, record_id: Column, block: Column, content_type: str, *more: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    head = _lines(
        "WARC/1.1",
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", record_id),
        f"WARC-Date: {DATE}",
        *more,
        f"Content-Type: {content_type}",
        _field("Content-Length", F.octet_length(block)),
        "",
    )
    return F.concat(head, block)


def write_archives(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a request, a response or revisit and a metadata record for every row to gzipped archives under path."""
    spark = df.sparkSession
    pages = df.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    pages = pages.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256), "ordinal": F.lit(0)})
    alone = F.concat_ws(":", F.lit("null"), F.md5(F.coalesce("url", F.lit(""))), F.col("url").isNull().cast("string"), "digest")
    pages = pages.withColumn("name", F.coalesce(F.col("id").cast("string"), alone))
    thin, thin_path = common.materialise(pages.select("id", "name", "ordinal", "bytes", "digest"))
    large = not thin.where(F.col("bytes") > LARGE).isEmpty()
    if not thin.groupBy("name").count().where("count > 1").isEmpty():
        pages = pages.withColumn("ordinal", F.row_number().over(W.partitionBy("name").orderBy("url", "html")) - 1)
        common.discard(spark, thin_path)
        thin, thin_path = common.materialise(pages.select("id", "name", "ordinal", "bytes", "digest"))
    able = thin.where((F.col("bytes") >= min_revisit) & F.col("id").isNotNull())
    firsts = able.groupBy("digest").agg(F.min(F.struct("id", "ordinal")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = able.join(firsts, "digest").where(F.struct("id", "ordinal") > F.col("first"))
    again, again_path = common.materialise(again.select("id", "ordinal", "first"))
    pages = pages.join(again, ["id", "ordinal"], "left")

    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    uri = _field("WARC-Target-URI", target)
    own, revisited = _record_id("response", F.col("name"), F.col("ordinal")), F.col("first").isNotNull()
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _field("Content-Length", F.col("bytes")), "")
    response = _record(
        F.when(revisited, "revisit").otherwise("response"),
        own,
        F.concat(http, F.when(revisited, "").otherwise(F.col("html"))),
        "application/http;msgtype=response",
        uri,
        F.when(revisited, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        _field("WARC-Refers-To", F.when(revisited, _record_id("response", F.col("first.id"), F.col("first.ordinal")))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
    )
    asked = _lines(F.concat(F.lit("GET "), F.coalesce(F.regexp_extract(target, r"://[^/?#]*([^#]*)", 1), F.lit("/")), F.lit(" HTTP/1.1")), _field("Host", F.regexp_extract(target, r"://([^/?#]*)", 1)), "")
    request = _record("request", _record_id("request", F.col("name"), F.col("ordinal")), asked, "application/http;msgtype=request", uri, _field("WARC-Concurrent-To", own))
    fields = _lines(_field("page-id", F.col("id")), _field("payload-bytes", F.col("bytes")), _field("refers-to-page", F.col("first.id")))
    metadata = _record("metadata", _record_id("metadata", F.col("name"), F.col("ordinal")), fields, "application/warc-fields", uri, _field("WARC-Concurrent-To", own))
    # The separator that the writer puts behind every row is the end of a record.
    records = F.explode(F.array(request, response, metadata)).alias("value")
    for some, most in ((F.col("bytes") <= LARGE, records_per_file), (F.col("bytes") > LARGE, 3))[: 1 + large]:
        out = pages.where(some).select(records) if large else pages.select(records)
        out.write.mode("append").option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    common.discard(spark, thin_path, again_path)


def _unzipped(data: bytes) -> Iterator[bytes]:
    """An archive's bytes in parts, gzipped (in one or many members) or plain."""
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and data:
            part = member.decompress(data, PART_BYTES)
            data = member.unconsumed_tail
            if part:
                yield part
        data = member.unused_data.lstrip(b"\0")
    if data:
        yield data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an archive.

    The archive is unzipped in parts, so that a part and a record of it are held at a time.
    """
    parts, text, at = _unzipped(data), b"", 0
    while True:
        start = text.find(b"WARC/", at)
        end = text.find(b"\r\n\r\n", start) if start >= 0 else -1
        if end < 0:
            part = next(parts, b"")
            if not part:
                return
            text, at = text[start if start >= 0 else max(at, len(text) - 4) :] + part, 0
            continue
        lines = text[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at, size = end + 4, int(head["content-length"])
        if len(text) - at < size:
            whole = [text[at:]]
            have = len(whole[0])
            while have < size and (part := next(parts, b"")):
                whole.append(part)
                have += len(part)
            text, at = b"".join(whole), 0
        yield head, text[at : at + size]
        at += size


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, declared_digest string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for every record of the archives under path.

    payload is what follows the HTTP header of a request, response or revisit and the whole block of others; its size and
    SHA-256 come with it, and without payloads it is left out after that. fields has a metadata record's lines.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "declared_digest")]
            + [("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        rows, held = [], 0
        for batch in batches:
            for content in batch["content"]:
                for head, block in parse(content.as_py()):
                    body = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                    own = head.get("content-type") == "application/warc-fields"
                    fields = [(k, v.strip()) for k, colon, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if colon] if own else []
                    names = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest")
                    rows.append((*map(head.get, names), fields, len(body), hashlib.sha256(body).hexdigest(), body if payloads else None))
                    held += len(body) * payloads + 500
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for every capture: record_id, response, requests and metadata (lists of records)."""
    own = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    capture = F.col("type").isin("response", "revisit")
    known = records.where(capture | F.col("type").isin("request", "metadata"))
    of = lambda kind: F.collect_list(F.when(F.col("type") == kind, own))
    each = known.groupBy(F.when(capture, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("record_id"))
    out = each.agg(F.collect_list(F.when(capture, own)).alias("captures"), of("request").alias("requests"), of("metadata").alias("metadata"))
    return out.select("record_id", F.explode("captures").alias("response"), "requests", "metadata")


def query(spark, sf_dir: str) -> DataFrame:
    path = common.scratch(spark)
    write_archives(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    captures = assemble(read_archives(spark, path, payloads=False))
    fields, revisit = F.get("metadata", F.lit(0))["fields"], F.col("response.type") == "revisit"
    return captures.select(
        fields["page-id"].cast("long").alias("page_id"),
        F.when(revisit, fields["payload-bytes"].cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract("response.declared_digest", "^(?:sha256:)?(.*)$", 1)).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        fields["refers-to-page"].cast("long").alias("refers_to"),
        F.size("requests").alias("n_requests"),
    )


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < d.page_id THEN f.first END AS refers_to, 1 AS n_requests
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= {MIN_REVISIT}
"""
