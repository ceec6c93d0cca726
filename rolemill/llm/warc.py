"""A content-addressed archive of web records in WARC form.

`store` writes two tables. ``payloads``: each distinct payload once, under its SHA-256,
as a zstd frame. ``headers``: per record the exact bytes of its WARC and HTTP headers and
the digest of its payload. `restore` joins them back into the original records, byte by
byte, and reads the fields from the restored headers; `write_warc` and `read_warc`
exchange restored records with plain WARC files.

Copies meet by digest only: a task keeps one copy per digest before the shuffle, so a
payload that a third of all records share costs one row per task. That equal digests mean
equal bytes is verified when storing, by the length, SHA-1 and a 64-bit hash of every copy,
and when restoring, where SHA-256 and SHA-1 of the unpacked bytes are computed anew and
compared with address and header; a mismatch is an error. Of records with equal payloads
of at least ``REVISIT_BYTES`` the largest id is the response and the others are revisits
of it; smaller payloads are always responses.

A NULL payload is an empty one, a NULL url an empty target. Rows with a repeated id are
records of their own: all rows of the largest id are responses. Rows with a NULL id are
archived as records without an id; they are revisits if another row has an id, and a
response among themselves. Line ends in a url become spaces of the header. An empty
table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.llm.common import batch_of, slices
from rolemill.session import fix

REVISIT_BYTES = 1000
# Fixed values of the format.
VERSION = "WARC/1.1"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(id, url, date, payload): rows to archive; the payload as bytes."""
    plain = F.regexp_replace(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"[\r\n]+", " ")
    return pages.select(
        F.col(f"`{id}`").cast("long").alias("id"), plain.alias("url"), F.lit(date).alias("date"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))


def _digests(batches):
    for batch in slices(batches, "payload"):
        raw = batch.column("payload").to_pylist()
        press = zstandard.ZstdCompressor(level=3)
        yield batch_of({
            "address": (pa.binary(), [hashlib.sha256(p).digest() for p in raw]), "sha1": (pa.binary(), [hashlib.sha1(p).digest() for p in raw]),
            "size": (pa.int64(), [len(p) for p in raw]), "data": (pa.binary(), [press.compress(p) for p in raw])})


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def record_name(id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(">"))


def header_text(response: Column, id: Column, refers_to: Column, url: Column, date: Column, sha1: Column, size: Column) -> Column:
    """The header block of a record, up to and with the empty line before the payload.

    A revisit keeps the HTTP headers as its block; its payload is that of the record it refers to.
    """
    http = F.concat(F.lit(HTTP), _line("Content-Length", size.cast("string")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(response, size).otherwise(0)
    return F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(response, "response").otherwise("revisit")), _line("WARC-Record-ID", record_name(id)),
        _line("WARC-Date", date), _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(response, F.lit("")).otherwise(F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", record_name(refers_to)))),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", length.cast("string")), F.lit("\r\n"), http)


def store(rows: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write ``path``/payloads and ``path``/headers from rows (id, url, date, payload)."""
    packed = rows.select("payload").mapInArrow(_digests, "address binary, sha1 binary, size long, data binary")
    check = F.xxhash64("sha1", "size")
    once = packed.groupBy("address").agg(
        F.first("sha1").alias("sha1"), F.first("size").alias("size"), F.first("data").alias("data"), F.min(check).alias("_a"), F.max(check).alias("_b"))
    same = F.assert_true(F.col("_a") == F.col("_b"), F.lit("different payloads with one digest"))
    once.filter(same.isNull()).drop("_a", "_b").write.option("compression", "zstd").parquet(f"{path}/payloads")
    # the small columns only: no payload travels for the headers
    slim = rows.select("id", "url", "date", F.sha2("payload", 256).alias("_hex"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    slim = slim.withColumn("address", F.unhex("_hex")).drop("_hex")
    groups = slim.filter(F.col("size") >= revisit_bytes).groupBy("address").agg(F.max("id").alias("_top"), F.count("*").alias("_n"))
    groups = fix(groups.filter("_n > 1").drop("_n"))  # written, so that a hot digest's rows can be split in the join
    joined = slim.join(groups, "address", "left")
    response = F.col("_top").isNull() | F.col("id").eqNullSafe(F.col("_top"))
    text = header_text(response, F.col("id"), F.col("_top"), F.col("url"), F.col("date"), F.col("sha1"), F.col("size"))
    joined.select("address", text.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def field(text: Column, name: str) -> Column:
    """The value of a header field, NULL if the record has none; names in any case."""
    found = F.regexp_extract(text, rf"(?dim)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(text.rlike(rf"(?dim)^{name}:"), found)


def _unpack(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            raw = [zstandard.ZstdDecompressor().decompress(d) for d in part.column("data").to_pylist()]
            for address, p in zip(part.column("address").to_pylist(), raw):
                if hashlib.sha256(p).digest() != address:
                    raise ValueError("a stored payload does not have the digest it is stored under")
            yield batch_of({"header": (pa.binary(), part.column("header").to_pylist()), "payload": (pa.binary(), raw)})


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The archived records: (page_id, url, date, record_type, refers_to, payload_digest, payload_bytes, header, payload).

    ``header`` and ``payload`` are the original bytes; a revisit has the payload of the
    record it refers to. The other columns are read from the header.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads").select("address", "data")
    whole = headers.join(payloads, "address").select("address", "header", "data").mapInArrow(_unpack, "header binary, payload binary")
    return parse(whole)


def parse(whole: DataFrame) -> DataFrame:
    """Fields of records (header, payload) whose digests are checked against the payload."""
    text = F.element_at(F.split(F.col("header").cast("string"), END, 2), 1)
    text = F.concat(text, F.lit("\r\n"))
    number = lambda c: F.regexp_extract(c, r"<urn:record:(-?\d+)>", 1).try_cast("long")
    digest = F.regexp_extract(field(text, "WARC-Payload-Digest"), r"^sha1:([0-9a-f]{40})$", 1)
    sound = F.assert_true(digest == F.sha1("payload"), F.lit("a payload differs from the digest in its header"))
    return whole.filter(sound.isNull()).select(
        number(field(text, "WARC-Record-ID")).alias("page_id"), field(text, "WARC-Target-URI").alias("url"), field(text, "WARC-Date").alias("date"),
        field(text, "WARC-Type").alias("record_type"), number(field(text, "WARC-Refers-To")).alias("refers_to"), digest.alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "header", "payload")


def write_warc(restored: DataFrame, path: str, compression: str = "gzip") -> None:
    """Plain WARC files: header, payload of responses, two line ends per record."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    # text files keep the bytes of a string as they are
    restored.select(F.concat(F.col("header"), body).cast("string").alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _starts(rows):
    """Which pieces of one file begin a record: each record is as long as its header says."""
    rows = rows.sort_values(["block", "no"]).reset_index(drop=True)
    record, left, n = [], 0, 0
    for size, declared in zip(rows["size"], rows["declared"]):
        if left <= 0:
            n, left = n + 1, declared + len(SEPARATOR)
        left -= size + len(SEPARATOR)
        record.append(n)
    return rows.assign(record=record)[["file", "block", "no", "record"]]


SEPARATOR = f"{END}{VERSION}\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of the records of plain WARC files; revisits have an empty payload.

    Files are split at the first line of a record. A payload that holds such a line falls into
    pieces, which are put together again by the lengths in the headers: of a file only
    the places and lengths of its pieces meet in one task.
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(path)
    pieces = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"),
        F.col("value").cast("binary").alias("piece"))
    pieces = fix(pieces)
    text = F.regexp_replace(F.col("piece").cast("string"), f"^{VERSION}\r\n", "")
    # the first piece has the line that the others lost, the last one the end of its record
    body = F.when(F.col("piece").cast("string").startswith(f"{VERSION}\r\n"), F.expr(f"substring(piece, {len(VERSION) + 3})")).otherwise(F.col("piece"))
    head = F.element_at(F.split(text, END, 2), 1)
    declared = F.octet_length(head) + len(END) + F.coalesce(field(F.concat(head, F.lit("\r\n")), "Content-Length").try_cast("long"), F.lit(0))
    # sizes without the end of the last record
    sized = pieces.withColumn("body", body).withColumn("size", F.octet_length("body").cast("long")).withColumn("declared", declared.cast("long"))
    kind = "file string, block long, no long, record long"
    numbers = sized.select("file", "block", "no", "size", "declared").groupBy("file").applyInPandas(_starts, kind)
    whole = sized.join(numbers, ["file", "block", "no"]).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "no", "body", "declared"))).alias("parts"))
    joined = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["body"], lambda a, p: F.concat(a, F.lit(SEPARATOR.encode()), p["body"]))
    full = whole.select(F.substring(joined, F.lit(1), F.col("parts")[0]["declared"].cast("int")).alias("full"))
    # header: up to the second empty line where there are HTTP headers, else the first
    words = F.split(F.col("full").cast("string"), END, 3)
    http = F.lower(F.coalesce(field(F.concat(words[0], F.lit("\r\n")), "Content-Type"), F.lit(""))).startswith("application/http")
    size = F.octet_length(words[0]) + len(END) + F.when(http & (F.size(words) > 2), F.octet_length(words[1]) + len(END)).otherwise(0)
    return full.select(
        F.concat(F.lit(f"{VERSION}\r\n".encode()), F.substring("full", F.lit(1), size)).alias("header"),
        F.substring(F.col("full"), size + 1, F.octet_length("full")).alias("payload"))
