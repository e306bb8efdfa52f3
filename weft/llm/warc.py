"""Content-addressed WARC archive: payload bytes once, exact headers apart, records rebuilt by joins.

Payloads are keyed by SHA-256 and length. The record with the smallest page_id
of a payload is its response and carries the bytes; the others are revisits that
refer to it. Archives are WARC/1.1 files, gzipped, written by Spark's text sink
into the shared folder (the line separator is the last byte of a record, so
nothing is added). The reader goes through a file as a stream by Content-Length,
and verifies length, SHA-1 and SHA-256 of each payload. What it reads becomes two
tables: exact headers of all records, and payload bytes once by their SHA-256. A
join gives every record back, and checks the digest again.

Defined cases: a null html is an empty payload. Payloads below `min_bytes` are
all responses. Rows that repeat a response's page_id and payload are responses
too. A null page_id comes last: such a row is a response only if no row of its
payload has an id. Line breaks in a url are percent-encoded in its header. An
empty table gives an archive without records. Other columns are ignored.
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

from weft.llm.common import delete, materialise, scratch, scratch_scope

MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
#: Payload of an archive file at the table's mean size, and records at most; a file is read by one task, as a stream.
FILE_BYTES, RECORDS_PER_FILE = 32 << 20, 20_000
#: Bytes of payload in one batch on their way out of the reader.
BATCH_BYTES = 8 << 20


def base32_sha1(binary: Column) -> Column:
    """Bare upper-case base32 SHA-1: ten hex digits are eight base32 digits."""
    digest = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _digested(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("long").alias("bytes"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """One WARC record for each row of pages (page_id, url, html) below `path`."""
    rows = _digested(pages)
    # The least id of each payload that occurs more than once, combined before the shuffle: a hot payload is one row from each task.
    # Only ids and digests are counted; html crosses no shuffle unless the repeated payloads are too many to broadcast.
    counted = rows.select("page_id", "sha256", "bytes").groupBy("sha256", "bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = materialise(counted.filter("n > 1").select(F.col("sha256").alias("__s"), F.col("bytes").alias("__b"), "first_id"), "warc-first")
    few = F.broadcast(first) if first.count() <= BROADCAST_PAYLOADS else first
    joined = rows.join(few, (F.col("sha256") == F.col("__s")) & (F.col("bytes") == F.col("__b")), "left")
    revisit = (F.col("bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:weft:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(html.cast("binary")))),
        line("X-Payload-SHA256", F.col("sha256")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("first_id"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(header, F.when(revisit, "").otherwise(html), F.lit("\r\n\r"))
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit("")))).alias("b")).first()["b"] or 0
    per_file = max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / (mean + 500))))
    joined.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class _Stream:
    """Unpacked bytes of a gzip file, a piece at a time."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.buffer = memoryview(packed), 0, bytearray()
        self.unzip = zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.at < len(self.packed) or self.unzip.unconsumed_tail:
            piece = self.unzip.unconsumed_tail or bytes(self.packed[self.at : self.at + 65536])
            if not self.unzip.unconsumed_tail:
                self.at += 65536
            got = self.unzip.decompress(piece, 1 << 20)
            if self.unzip.eof and self.unzip.unused_data:
                self.at -= len(self.unzip.unused_data)
                self.unzip = zlib.decompressobj(31)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """What comes up to and with `mark`; empty at the end of the file."""
        seen = 0
        while (i := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if bytes(self.buffer).strip():
                    raise ValueError("a record is cut off")
                return b""
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record is cut off")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(packed: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(exact header, its fields, block) of each record of a gzipped WARC file, payload digests verified."""
    stream = _Stream(packed)
    while head := stream.until(b"\r\n\r\n"):
        text = head.decode()
        lines = text.split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:] if x)
        block = stream.take(int(fields["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record's end is missing")
        if fields["WARC-Type"] == "response":
            if hashlib.sha256(block).hexdigest() != fields["X-Payload-SHA256"] or str(len(block)) != fields["X-Payload-Length"] or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Payload-Digest"]:
                raise ValueError("a payload differs from its digest")
        yield text, fields, block


#: Up to this many repeated payloads (about 100 bytes each) are broadcast; beyond it, they are joined by shuffle.
BROADCAST_PAYLOADS = 200_000
#: Records of one payload that one task rebuilds; a hotter payload is copied for as many tasks as it needs.
SALT_ROWS = 20_000

_FIELDS = "page_id long, record_type string, refers_to long, sha256 string, payload_bytes long, payload_digest string, header string, payload binary"


def read_archive(spark: SparkSession, path: str, keep: tuple[str, ...] = ("header", "payload")) -> DataFrame:
    """A row for each record; payload_bytes, payload_digest (computed anew) and payload are null for revisits.

    `keep` says which of the wide columns header and payload come along.
    """

    def number(name: str | None) -> int | None:
        return None if name is None or name.endswith(":none>") else int(name.rpartition(":")[2][:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _FIELDS.split(", ")]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for header, f, block in records(batch.column("content")[i].as_py()):
                    response = f["WARC-Type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode() if response else None
                    rows.append((number(f["WARC-Record-ID"]), f["WARC-Type"], number(f.get("WARC-Refers-To")), f["X-Payload-SHA256"], len(block) if response else None, digest, header if "header" in keep else None, block if response and "payload" in keep else None))
                    size += len(block) + len(header)
                    if size > BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _FIELDS).drop(*{"header", "payload"}.difference(keep))


def contents(archive: DataFrame) -> DataFrame:
    """sha256 and what is stored of each payload, once."""
    stored = [c for c in ("payload_bytes", "payload_digest", "payload") if c in archive.columns]
    return archive.filter("record_type = 'response'").groupBy("sha256").agg(*[F.first(c).alias(c) for c in stored])


def split_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables behind an archive: exact headers of all records, and each payload's bytes once, by its digest."""
    headers = materialise(read_archive(spark, path, ("header",)).select("page_id", "record_type", "refers_to", "sha256", "header"), "warc-headers")
    # Responses are one for each payload but for those below the least size and repeated or missing ids; only then bytes are grouped.
    stored = read_archive(spark, path, ("payload",)).filter("record_type = 'response'")
    several = headers.filter("record_type = 'response'").groupBy("sha256").count().filter("count > 1").limit(1).count()
    payloads = materialise((contents(stored) if several else stored).select("sha256", "payload"), "warc-payloads")
    return headers, payloads


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record with its whole payload (revisits get theirs through the digest) and `record`: exact header and payload.

    The digest of each payload is taken again after the join; one that differs raises.
    """
    hot = headers.groupBy("sha256").agg(F.count("*").alias("n")).filter(F.col("n") > SALT_ROWS).select(F.col("sha256").alias("__hot"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("__parts"))
    # At most one row for SALT_ROWS records.
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_PAYLOADS else hot
    parts = F.coalesce("__parts", F.lit(1))
    salted = headers.join(hot, F.col("sha256") == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64("page_id", "header"), parts).cast("int")).drop("__hot", "__parts")
    copies = payloads.join(hot, F.col("sha256") == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__hot", "__parts")
    joined = salted.join(copies, ["sha256", "__salt"], "left").drop("__salt")
    sound = F.sha2("payload", 256) == F.col("sha256")
    payload = F.when(F.coalesce(sound, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no payload of digest "), F.col("sha256"))).cast("binary"))
    checked = joined.withColumn("payload", payload)
    return checked.withColumn("record", F.concat(F.col("header").cast("binary"), F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))


def op8_warc_archive(spark, sf_dir):
    with scratch_scope():
        path = scratch(spark, "warc")
        try:
            write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
            tables = split_archive(spark, path)
            delete(spark, path)
            rebuilt = reconstruct(*tables)
            found = rebuilt.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))
            return materialise(found, "warc-result", outer=True)
        finally:
            delete(spark, path)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS u FROM pages),
d AS (SELECT *, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: CAST(concat('0x', substr(x, 1 + 10 * (i // 8), 10)) AS BIGINT) // CAST(pow(32, 7 - i % 8) AS BIGINT) % 32) AS v FROM d),
c AS (SELECT *, array_to_string(list_transform(v, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(k + 1 AS INTEGER), 1)), '') AS digest, page_id <> first_id AS again, chr(13) || chr(10) AS nl FROM b),
e AS (SELECT *, 'WARC/1.1' || nl || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || nl || 'WARC-Record-ID: <urn:weft:page:' || page_id || '>' || nl || 'WARC-Target-URI: ' || u || nl
    || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Payload-Digest: sha1:' || digest || nl || 'X-Payload-SHA256: ' || sha256(h) || nl || 'X-Payload-Length: ' || n || nl
    || CASE WHEN again THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl || 'WARC-Refers-To: <urn:weft:page:' || first_id || '>' || nl ELSE '' END
    || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END || nl || nl AS header FROM c)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to, sha256(header || h) AS record_sha256 FROM e
"""
