"""A content-addressed WARC archive.

``write_archive`` writes one record per page: of pages with equal payloads one with the largest id
keeps the payload bytes (a response record), the others become revisit records that name it. Records
are put together by DataFrame functions and written by Spark's own text writer, byte for byte, as gzip:
so any file system that Spark can write will do, and its commit protocol keeps the files of one
attempt of each task only. An archive's files are ``part-*.txt.gz``.

``read_archive`` reads the files back. ``split_archive`` puts them into a store: the payloads once per
strong digest (SHA-256, checked on the bytes as they are stored, as is the SHA-1 in the record), and the
exact record headers separately. ``rebuild_records`` joins the two to the original records, and
``rebuild_pages`` to the original pages.

No payload is moved for a revisit, copies are summed up in each task before any shuffle, and joins on a
digest are dealt by salt, so a payload that a third of all pages share meets in no task.

Edge cases: a null payload is empty; a null url has no target field; a null id reads back as null; repeated
rows each get a record, one of them at most a response; an empty table gives an archive without records
and no rows; pages of one id with different payloads keep their own digests. Control characters
in a url are escaped in the target field, and the url is kept in a field of its own in hexadecimal digits.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, pick, salted, shuffle_partitions, work_path

#: Payload bytes that one archive file holds in the mean, at most.
FILE_BYTES = 64 << 20
#: Bytes of records that a parsing task holds before it hands them on.
HELD_BYTES = 4 << 20
HEADERS = "page_id long, url string, record_type string, refers_to long, payload_digest string, strong_digest binary, header binary, http binary"
PAYLOADS = "strong_digest binary, payload_digest string, payload_bytes long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = r"[\x00-\x20\x7f]"
#: The digits of base 32 in the number system of ``conv`` and in that of the standard.
_BASE_32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# --- writing


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in base 32: five hexadecimal digits make four."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), *_BASE_32)


def _escaped(url: Column) -> Column:
    marked = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(_CONTROL), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c))
    return F.when(url.rlike(_CONTROL), F.array_join(marked, "")).otherwise(url)


def _record_id(page_id: Column, url: Column, task: Column, strong: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), F.lower(F.hex(F.xxhash64(page_id, url, task, strong))), F.lit("."), copy.cast("string"), F.lit(">"))


def _header(own: Column, keeper: Column) -> Column:
    """A record's WARC and HTTP headers as bytes: all of a record but the payload and the closing line ends."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("revisit")
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), own, F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), _escaped(F.col("url")), F.lit("\r\nX-Target-URI-Hex: "), F.hex(F.encode("url", "UTF-8"))), F.lit("")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), keeper, F.lit(f"\r\nWARC-Profile: {_PROFILE}"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\nX-Payload-SHA256: "), F.lower(F.hex("strong")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string"), F.lit("\r\n\r\n"), http,
    ]
    return F.concat(*lines).cast("binary")


def write_archive(pages: DataFrame, folder: str, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes the archive into ``folder``. Payloads of fewer than ``min_bytes`` bytes are kept in each record.

    Which record keeps a payload is settled on ids and digests; each payload then moves once for each
    task that reads it. Equal rows of one task are one row with a number until the records are written.
    """
    spark = pages.sparkSession
    rows = pick(pages, page_id=id_col, url=url_col, payload=payload_col)
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("strong", F.unhex(F.sha2("payload", 256)))
    narrow = rows.select("page_id", "url", "strong", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), F.spark_partition_id().alias("task"))
    narrow = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("n"))
    narrow = materialize(narrow, f"{folder}/_pages", 8)

    keepers = narrow.groupBy("strong").agg(F.max(F.struct("page_id", "url", "task")).alias("keeper"))
    known = salted(narrow, keepers, "strong", "page_id", "url", "task")
    keeps = F.col("page_id").eqNullSafe(F.col("keeper.page_id")) & F.col("url").eqNullSafe(F.col("keeper.url")) & (F.col("task") == F.col("keeper.task"))
    each = known.withColumn("keeps", keeps).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    each = each.withColumn("revisit", (F.col("bytes") >= min_bytes) & ~(F.col("keeps") & (F.col("copy") == 1)))
    own = _record_id(F.col("page_id"), F.col("url"), F.col("task"), F.col("strong"), F.col("copy"))
    keeper = _record_id(F.col("keeper.page_id"), F.col("keeper.url"), F.col("keeper.task"), F.col("strong"), F.lit(1))
    headed = each.select("strong", "revisit", _header(own, keeper).alias("head"), F.xxhash64(own).alias("spread"))

    payloads = rows.groupBy("strong").agg(F.any_value("payload").alias("payload"))
    responses = headed.where("not revisit")
    full = responses.join(payloads, "strong") if min_bytes <= 0 else salted(responses, payloads, "strong", "spread")
    total = narrow.groupBy("strong").agg(F.max("bytes").alias("bytes")).agg(F.sum("bytes")).first()[0] or 0
    if total > FILE_BYTES * shuffle_partitions(spark):  # too few tasks for files that a task can read back whole
        full = full.repartition(-(-total // FILE_BYTES), "spread")
    # the line end that the text writer adds is the last byte of a record
    whole = full.select(F.concat("head", "payload", F.lit(b"\r\n\r")).alias("record")).unionByName(headed.where("revisit").select(F.concat("head", F.lit(b"\r\n\r")).alias("record")))
    whole.select(F.col("record").cast("string")).write.mode("overwrite").option("compression", "gzip").option("lineSep", "\n").text(f"{folder}/warc")


# --- reading


def parse_records(raw: bytes) -> Iterator[tuple[bytes, dict[bytes, bytes], bytes]]:
    """(header, its fields, block) of each record of an archive file, gzip or plain, whether in one member or many."""
    source = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    with source as f:
        while line := f.readline():
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record where one should begin: {line[:40]!r}")
            lines = [line]
            while lines[-1] not in (b"\r\n", b""):
                lines.append(f.readline())
            fields = dict(x.rstrip(b"\r\n").split(b": ", 1) for x in lines[1:-1])
            size = int(fields[b"Content-Length"])
            block = f.read(size)
            if len(block) < size:
                raise ValueError("an archive file ends within a record")
            yield b"".join(lines), fields, block


def _page(name: bytes | None) -> int | None:
    part = name[len(b"<urn:page:") :].split(b":")[0] if name else b"null"
    return None if part == b"null" else int(part)


def _checked(fields: dict[bytes, bytes], payload: bytes) -> tuple:
    import base64

    strong, sha1 = hashlib.sha256(payload), base64.b32encode(hashlib.sha1(payload).digest())
    if strong.hexdigest().encode() != fields[b"X-Payload-SHA256"] or b"sha1:" + sha1 != fields[b"WARC-Payload-Digest"]:
        raise ValueError(f"payload of {fields[b'WARC-Record-ID']!r} differs from its digest")
    return strong.digest(), sha1.decode(), len(payload), payload


def _parsed(spark: SparkSession, folder: str, schema: str, row) -> DataFrame:
    """Rows (``schema``) that ``row(header, fields, block)`` makes of the records; none for those it gives None for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(f"{folder}/warc").select("content")
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for header, fields, block in parse_records(raw.as_py()):
                    made = row(header, fields, block)
                    if made is None:
                        continue
                    rows.append(made)
                    held += len(header) + len(block)
                    if held > HELD_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return files.mapInArrow(lean(run), schema)


def read_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers) as they lie in the files: the payload of each response, checked against both digests (a mismatch is an error), and the headers of all records."""

    def payload(header: bytes, fields: dict[bytes, bytes], block: bytes) -> tuple | None:
        return _checked(fields, block.partition(b"\r\n\r\n")[2]) if fields[b"WARC-Type"] == b"response" else None

    def head(header: bytes, fields: dict[bytes, bytes], block: bytes) -> tuple:
        http, gap, _ = block.partition(b"\r\n\r\n")
        url = fields.get(b"X-Target-URI-Hex")
        url = None if url is None else bytes.fromhex(url.decode()).decode()
        refers = _page(fields.get(b"WARC-Refers-To"))
        return _page(fields[b"WARC-Record-ID"]), url, fields[b"WARC-Type"].decode(), refers, fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), bytes.fromhex(fields[b"X-Payload-SHA256"].decode()), header, http + gap

    return _parsed(spark, folder, PAYLOADS, payload), _parsed(spark, folder, HEADERS, head)


def split_archive(spark: SparkSession, folder: str, store: str) -> tuple[DataFrame, DataFrame]:
    """Reads an archive into a store: payload bytes once per verified strong digest, and the exact headers of all records, as two tables."""
    payloads, headers = read_archive(spark, folder)
    headers = materialize(headers, f"{store}/headers", codec="zstd")
    several = headers.where("record_type = 'response'").groupBy("strong_digest").count().where("count > 1")
    if not several.isEmpty():  # payloads that were too small for revisits
        payloads = payloads.dropDuplicates(["strong_digest"])
    return materialize(payloads, f"{store}/payloads", codec="zstd"), headers


def rebuild_records(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """All columns of ``headers`` with ``payload_bytes``, ``payload`` (the full payload that a record stands for) and ``record``, its original bytes.

    A record whose payload is not in the store, or whose digest is not that of the stored bytes, is an error.
    """
    stored = payloads.select("strong_digest", F.col("payload_digest").alias("stored_digest"), "payload_bytes", "payload")
    joined = salted(headers, stored, "strong_digest", "header", how="left")
    wrong = F.when(F.col("stored_digest").isNull(), "a record's payload is missing").when(F.col("stored_digest") != F.col("payload_digest"), "a record's digest is not that of its payload")
    digest = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("stored_digest"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("payload_digest", digest).drop("stored_digest").withColumn("record", F.concat("header", "http", body, F.lit(b"\r\n\r\n")))


def rebuild_pages(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """The archived pages: page_id, url, payload."""
    return rebuild_records(payloads, headers).select("page_id", "url", "payload")


def archive_report(spark: SparkSession, folder: str, store: str | None = None) -> DataFrame:
    """One row per record of an archive, read through its store: size and digest of the full payload, and what the record refers to.

    Size and digest were taken from the payload's bytes when they were stored, so the join need not move them.
    """
    rebuilt = rebuild_records(*split_archive(spark, folder, store or work_path(spark, "warc-store")))
    return rebuilt.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
