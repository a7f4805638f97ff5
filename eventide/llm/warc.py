"""WARC archives as a chunked record table.

A record is a sequence of rows (archive, record_id, chunk_no, data, digest): chunk 0 is the WARC header, later
chunks carry at most ``CHUNK`` bytes of payload each, the last one the record's end. An archive's data,
joined by (record_id, chunk_no), is a WARC/1.1 file byte for byte (``archive_bytes`` streams it). ``digest`` is
the SHA-1 of the payload up to and including that chunk, so a reader verifies as it goes and knows the
first chunk that is damaged. Writing and reading hold one chunk at a time beside the row that came in.

Records with equal payloads (SHA-1, SHA-256 and length) of at least ``min_bytes`` bytes are stored once: the one with
the largest identifier is a response, the others are revisit records that refer to it.

Defined results: null payload is empty; a null URL is written as an empty target; rows that repeat a page
are separate records, all of the largest identifier are responses; a null identifier is never referred to
and is a response if all its copies have none; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import buffered, materialise

CHUNK = 64 << 10
_END = b"\r\n\r\n"
_CHUNKS = pa.schema([("archive", pa.int64()), ("record_id", pa.int64()), ("copy", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("digest", pa.string())])
CHUNKS_DDL = "archive long, record_id long, copy long, chunk_no long, data binary, digest string"
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(h) -> str:
    return base64.b32encode(h.digest()).decode()


def _clean(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def _id(record_id: int | None) -> str:
    return "" if record_id is None else f"<urn:page:{record_id}>"


def write_record(record_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> Iterator[tuple[int, bytes, str]]:
    """(chunk_no, data, digest so far) of one record; the payload is cut, never copied whole.

    A revisit has no body; its header still tells the payload's length and digest.
    """
    view = memoryview(payload)
    whole = hashlib.sha1(view)
    header = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(record_id)}", f"WARC-Target-URI: {_clean(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(whole)}", f"X-Payload-Length: {len(view)}"]
    if kind == "revisit":
        header += [f"WARC-Refers-To: {_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    size = len(view) if kind == "response" else 0
    header += ["Content-Type: text/html", f"Content-Length: {size}"]
    running = hashlib.sha1()
    yield 0, ("\r\n".join(header) + "\r\n\r\n").encode("utf-8", "surrogatepass"), base32_sha1(running)
    number = 1
    for at in range(0, size, CHUNK):
        part = view[at : at + CHUNK]
        running.update(part)
        yield number, bytes(part), base32_sha1(running)
        number += 1
    yield number, _END, base32_sha1(running)


def _number(value: str) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value else None


class RecordReader:
    """Feeds on chunks of one record in order; ``finish`` gives its row."""

    def __init__(self, header: bytes) -> None:
        lines = header.decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1" or lines[-2:] != ["", ""]:
            raise ValueError("not a WARC record header")
        self.fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:-2])
        self.left, self.sha, self.ended = int(self.fields["Content-Length"]), hashlib.sha1(), False

    def feed(self, data: bytes, digest: str) -> None:
        if self.left:
            if len(data) > self.left:
                raise ValueError("payload is longer than its Content-Length")
            self.sha.update(data)
            self.left -= len(data)
        elif data == _END and not self.ended:
            self.ended = True
        else:
            raise ValueError("record does not end where its Content-Length says")
        if base32_sha1(self.sha) != digest:
            raise ValueError(f"damaged chunk in {self.fields['WARC-Record-ID']}")

    def finish(self) -> tuple:
        if self.left or not self.ended:
            raise ValueError(f"truncated record {self.fields['WARC-Record-ID']}")
        f, kind = self.fields, self.fields["WARC-Type"]
        told = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and told != base32_sha1(self.sha):
            raise ValueError(f"payload digest differs in {f['WARC-Record-ID']}")
        return _number(f["WARC-Record-ID"]), int(f["X-Payload-Length"]), told, kind, _number(f.get("WARC-Refers-To", ""))


def roles(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(r_id, r_sha, kind, refers_to) for each distinct (identifier, payload); only digests are shuffled."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    keys = pages.select(F.col(id_col).cast("long").alias("r_id"), F.unhex(F.sha2(body, 256)).alias("r_sha"), F.unhex(F.sha1(body)).alias("r_sha1"), F.octet_length(body).cast("long").alias("r_bytes"))
    owners = materialise(keys.groupBy(F.col("r_sha").alias("o_sha"), F.col("r_sha1").alias("o_sha1"), F.col("r_bytes").alias("o_bytes")).agg(F.max("r_id").alias("owner")), "owners")
    joined = keys.join(owners, (F.col("r_sha") == F.col("o_sha")) & (F.col("r_sha1") == F.col("o_sha1")) & (F.col("r_bytes") == F.col("o_bytes")))
    revisit = (F.col("r_bytes") >= min_bytes) & ~F.col("r_id").eqNullSafe(F.col("owner"))
    return joined.select("r_id", "r_sha", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("owner")).alias("refers_to")).distinct()


def _write(batches):
    def rows():
        for b in batches:
            columns = [b.column(c) for c in ("archive", "record_id", "copy", "url", "payload", "kind", "refers_to")]
            for k in range(b.num_rows):
                archive, record, copy, url, payload, kind, refers = (c[k] for c in columns)
                body = payload.as_buffer() if payload.is_valid else b""
                for number, data, digest in write_record(record.as_py(), url.as_py(), body, kind.as_py(), refers.as_py()):
                    yield archive.as_py(), record.as_py(), copy.as_py(), number, data, digest

    yield from buffered(rows(), _CHUNKS, size=1024)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archives: int | None = None) -> DataFrame:
    """The chunk table; ``archives`` files (by default one for each 4,096 records)."""
    role = materialise(roles(pages, id_col, payload_col, min_bytes), "roles")
    archives = archives or max(1, -(-role.count() // 4096))
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("copy", F.monotonically_increasing_id()).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    joined = rows.join(role, F.col("record_id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")))
    dealt = joined.select(F.pmod(F.xxhash64("record_id"), F.lit(archives)).alias("archive"), "record_id", "copy", "url", "payload", "kind", "refers_to")
    return dealt.mapInArrow(_write, CHUNKS_DDL)


def _read(batches):
    def rows():
        last, reader = None, None
        for b in batches:
            for archive, record, copy, number, data, digest in zip(*(c.to_pylist() for c in b.columns)):
                here = (archive, record, copy)
                if here != last:
                    if reader is not None:
                        yield reader.finish()
                    if number:
                        raise ValueError(f"record {record} has no header")
                    last, reader, want = here, RecordReader(data), 1
                    continue
                if number != want:
                    raise ValueError(f"record {record} lacks chunk {want}")
                want += 1
                reader.feed(data, digest)
        if reader is not None:
            yield reader.finish()

    yield from buffered(rows(), _READ)


def read_archives(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, each chunk verified.

    Rows are dealt by record, so one very large payload is read by one task, chunk by chunk.
    """
    keys = ["archive", "record_id", "copy", "chunk_no"]
    return chunks.repartition("archive", "record_id", "copy").sortWithinPartitions(*keys).select(*keys, "data", "digest").mapInArrow(_read, READ_DDL)


def archive_bytes(chunks: DataFrame, archive: int) -> Iterator[bytes]:
    """Streams one archive as the bytes of a WARC file, for export."""
    rows = chunks.where(F.col("archive") == archive).orderBy("record_id", "copy", "chunk_no").select("data")
    for row in rows.toLocalIterator():
        yield bytes(row.data)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, unhex(sha1(h)) AS s, max(page_id) OVER (PARTITION BY h) AS owner FROM p),
bits AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(CAST(CAST(s AS BIT) AS VARCHAR), 5 * i + 1, 5) AS INTEGER), 1)) AS letters FROM w)
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM bits
"""
