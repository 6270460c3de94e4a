"""WARC archives: writing, reading, and resolving equal payloads to revisit records.

Archives are written by Spark's text writer: a record is one value, the blank lines behind it are
the line separator, so files are committed like any other table and any Hadoop file system works.
They are read with ``binaryFile`` and parsed by Content-Length, so payloads may hold anything.
A reading task holds one file: ``records_per_file`` bounds it on writing.

Revisit resolution moves headers only. They are grouped by payload digest (minima are combined before the shuffle),
joined back to the first record of their digest, and the archives are read again for the payloads
that stay. Payloads meet the ids of the revisits in an anti join; Spark broadcasts these ids where
their table is small and shuffles otherwise.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.llm.tables import checkpointed, new_dir, require

RECORDS_PER_FILE = 2_000
MIN_PAYLOAD = 100
BATCH_BYTES = 4 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADERS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("refers_to_row", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)
RECORDS = T.StructType([*HEADERS.fields, T.StructField("payload", T.BinaryType())])


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing for NULL; line ends within the value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write rows with the columns of ``RECORDS`` as gzipped archives below ``path``.

    Responses hold an HTTP head and the payload, revisits the head alone; both name length and
    digest of the whole payload.
    """
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END),
    )
    block = F.when(revisit, F.encode(http, "UTF-8")).otherwise(F.concat(F.encode(http, "UTF-8"), "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.col("refers_to_id")),
        _line("X-Row-Id", F.col("row_id")),
        _line("X-Refers-To-Row", F.col("refers_to_row")),
        _line("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("_block").cast("string"),
        F.lit(END),
    )
    rows = records.withColumn("_block", block)
    rows = rows.select(F.concat(F.encode(head, "UTF-8"), "_block").cast("string").alias("value"))
    options = {"lineSep": END, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": records_per_file}
    rows.write.options(**options).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        at = end + 4 + length + 4
        if len(data) < at - 4:
            raise ValueError("the last record is cut short")
        yield headers, data[end + 4 : end + 4 + length]


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records below ``path``: the columns of ``RECORDS``, or of ``HEADERS`` without the payload.

    Length and digest of a response are computed from its payload and must equal its headers'.
    """
    schema = RECORDS if payload else HEADERS
    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                for h, block in parse_archive(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind = h["warc-type"]
                    body = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    size = int(h.get("x-payload-length", len(body or b"")))
                    if body is not None and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"payload of {h['warc-record-id']} does not fit its headers")
                    row = (h["warc-record-id"], kind, _number(h.get("x-row-id")), h.get("warc-target-uri"), h["warc-date"],
                           h.get("warc-refers-to"), _number(h.get("x-refers-to-row")), size, digest)
                    rows.append((*row, body) if payload else row)
                    held += 200 + (len(body) if payload and body else 0)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, schema)


def page_records(pages: DataFrame, row_id: str, url: str, html: str) -> DataFrame:
    """A response record per row: payload is the text in UTF-8, empty for NULL. Repeated rows get
    records of their own."""
    require(pages, row_id, url, html)
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col(row_id).cast("bigint").alias("row_id"),
        F.col(url).alias("uri"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.lit(None).cast("string").alias("refers_to_id"),
        F.lit(None).cast("bigint").alias("refers_to_row"),
        body.alias("payload"),
    )
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))


def resolve_revisits(spark: SparkSession, source: str, target: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Write the archives of ``source`` to ``target`` with each payload of at least ``min_payload``
    bytes once.

    Of equal payloads the record with the smallest row id (NULL last, ties by record id) is the
    response, all others become revisits of it. Revisits in the source are resolved likewise: one
    whose original is there refers to the response that stays for its digest; one whose original
    is missing stays a revisit with the headers it has. Smaller payloads stay responses.
    """
    headers = checkpointed(read_archives(spark, source, payload=False))
    order = F.struct(F.col("row_id").isNull().alias("none"), F.col("row_id"), F.col("record_id"))
    response = F.col("record_type") == "response"
    firsts = checkpointed(
        headers.filter(F.col("payload_bytes") >= min_payload)
        .groupBy("payload_digest")
        .agg(F.min(F.when(response, order)).alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select("payload_digest", F.col("first.record_id").alias("first_id"), F.col("first.row_id").alias("first_row"))
    )
    later = headers.join(firsts, "payload_digest").filter("record_id <> first_id")
    revisits = checkpointed(
        later.withColumns({"record_type": F.lit("revisit"), "refers_to_id": F.col("first_id"), "refers_to_row": F.col("first_row")})
        .select(*HEADERS.names)
    )
    kept = read_archives(spark, source).join(revisits.select("record_id"), "record_id", "left_anti")
    fresh = kept.select(*RECORDS.names).unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")))
    write_archives(fresh.withColumn("date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")), target)


def deduplicated_pages(pages: DataFrame, row_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write a record per page, resolve revisits, and read the headers of the deduplicated archives."""
    spark = pages.sparkSession
    first, second = new_dir(spark, "warc"), new_dir(spark, "warc")
    write_archives(page_records(pages, row_id, url, html), first)
    resolve_revisits(spark, first, second, min_payload)
    return read_archives(spark, second, payload=False)
