"""WARC archives: writing, reading, and resolving repeated payloads to revisit records.

Records are laid out by SQL functions and written by Spark's text writer with the
end-of-record mark as line separator, so archives go to any store Spark can write,
under its commit protocol. Files are bounded in bytes by the sizes of their records:
small ones stand together in files of many, large ones in files of few or of one. They
are read back as whole files and parsed by their declared lengths.
"""

from __future__ import annotations

import gzip
import hashlib
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import scratch_dir

END_OF_RECORD = "\r\n\r\n"
RECORDS_PER_FILE = 4096
#: Payloads of at most so many bytes stand together in files of so many records, which makes 256 MB at most; larger ones by themselves.
SIZES = ((1 << 16, RECORDS_PER_FILE), (1 << 20, 256), (1 << 24, 16))
WRITERS = 16
MIN_REVISIT_BYTES = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to_record", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. Line breaks in a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def record_text(records: DataFrame) -> Column:
    """A whole record without its end mark, from the columns of ``RECORDS``.

    A revisit has the HTTP head of its response and no payload.
    """
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("payload").cast("string"), F.lit("")))
    block = F.concat(head, body)
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.col("refers_to_record")),
        _line("WARC-Refers-To-Page-ID", F.col("refers_to")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> str:
    """Write ``records`` (columns of ``RECORDS``) as gzipped archives under ``path``, in folders by the size of their records."""
    spark = records.sparkSession
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    seen = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # records before this one in its task
    kind, slot = F.lit(0), F.lit(0).cast("long")
    for k, (most, _) in enumerate(SIZES):
        each = SIZES[k + 1][1] if k + 1 < len(SIZES) else 1
        kind = F.when(size > most, k + 1).otherwise(kind)
        slot = F.when(size > most, F.floor(seen / each)).otherwise(slot)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", WRITERS)  # beyond these, Spark sorts a task's records by file
    try:
        (
            records.select(record_text(records).alias("value"), kind.alias("size_class"), slot.alias("slot"))
            .write.option("lineSep", END_OF_RECORD)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", records_per_file)
            .partitionBy("size_class", "slot")
            .text(path)
        )
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", before) if before is not None else spark.conf.unset("spark.sql.maxConcurrentOutputFileWriters")
    return path


def parse_warc(stream):
    """``(headers, block)`` for each record of a readable stream of bytes; header names in lower case."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends within a record")
        yield headers, block


def _record(headers: dict, block: bytes, with_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    number = lambda name: int(headers[name]) if name in headers else None
    if kind == "revisit":
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest, payload = headers["warc-payload-digest"].removeprefix("sha256:"), None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if headers.get("warc-payload-digest", f"sha256:{digest}") != f"sha256:{digest}":
            raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    return (
        headers["warc-record-id"],
        kind,
        number("warc-page-id"),
        headers.get("warc-target-uri"),
        headers.get("warc-date"),
        digest,
        size,
        headers.get("warc-refers-to"),
        number("warc-refers-to-page-id"),
        payload if with_payload else None,
    )


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; each payload is checked against its digest."""

    def run(batches):
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=RECORDS.names)

        held, used = [], 0
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                source = io.BytesIO(data)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=source)) if bytes(data[:2]) == b"\x1f\x8b" else source
                for headers, block in parse_warc(stream):
                    held.append(_record(headers, block, with_payload))
                    used += 300 + (len(block) if with_payload else 0)
                    if used > 4 << 20:
                        yield pack(held)
                        held, used = [], 0
        if held:
            yield pack(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record for each row of ``pages``. Null html is an empty payload; null ids and urls have no header."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.sha2(payload, 256).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to_record"),
        F.lit(None).cast("long").alias("refers_to"),
        payload.alias("payload"),
    )


def revisits(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``record_id, original_record, original_page`` of each record that repeats an earlier payload.

    Of equal payloads the record with the smallest page id is the original (null ids
    last, then by record id). Counting by digest combines before the shuffle, and only
    digests that repeat are joined back, so a digest of a third of all records weighs on
    the join alone, which Spark splits.
    """
    large = headers.filter(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id", "record_id")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    repeated = large.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        large.join(repeated, "payload_digest")
        .filter(F.col("record_id") != F.col("first.record_id"))
        .select("record_id", F.col("first.record_id").alias("original_record"), F.col("first.page_id").alias("original_page"))
    )


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> str:
    """Rewrite the archives under ``source`` to ``target``: repeats become revisit records.

    Each record gets a fresh id and date; a revisit names its original's new id.
    New ids are derived from old ones, so both sides of a reference agree without a join.
    """
    found = revisits(read_warc(spark, source, with_payload=False), min_bytes)
    fresh = lambda c: F.concat(
        F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.col(c).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")
    )
    is_revisit = F.col("original_record").isNotNull()
    records = (
        read_warc(spark, source)
        .join(found, "record_id", "left")
        .select(
            fresh("record_id").alias("record_id"),
            F.when(is_revisit, F.lit("revisit")).otherwise(F.col("record_type")).alias("record_type"),
            "page_id",
            "url",
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
            "payload_digest",
            "payload_bytes",
            F.when(is_revisit, fresh("original_record")).otherwise(F.col("refers_to_record")).alias("refers_to_record"),
            F.when(is_revisit, F.col("original_page")).otherwise(F.col("refers_to")).alias("refers_to"),
            F.when(~is_revisit, F.col("payload")).alias("payload"),
        )
    )
    return write_warc(records, target, records_per_file)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive ``pages``, deduplicate the archives, and return what the result holds.

    One row for each page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    Null html is an empty payload. Payloads under ``min_bytes`` are never revisits. Rows
    with a null page id are archived without one; of equal payloads they come last, and a
    revisit of such a record has a null ``refers_to``. Of repeated rows one is the
    response. Columns other than the three of ``pages`` are not read. An empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    root = scratch_dir(spark)
    source = write_warc(page_records(pages), f"{root}/first")
    target = resolve_revisits(spark, source, f"{root}/resolved", min_bytes)
    return read_warc(spark, target, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
