"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

The reader inflates member after member with ``zlib.decompressobj`` in small pieces, frames each block by its
Content-Length, and verifies block and payload digests. Records whose payload an earlier page (smaller id) has
are revisits that carry digest and length but no payload.

Defined results: a null payload is empty; a null url leaves out the target URI; rows that repeat the smallest
id of their payload are all responses; a payload that only rows without id have is a response; an empty table
gives no archives and an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import cut, file_system, fresh_path, prepare, sized, tidied, write_file

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 16
#: Repeated payloads (about 150 bytes each in a hash table) that may be broadcast.
BROADCAST_PAYLOADS = 300_000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A record with ``refers_to`` is a revisit and leaves the payload out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if revisit else http + payload
    name = "none" if page_id is None else page_id
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", _uri(url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(CRLF + CRLF) + packer.flush()


def members(stream) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one at a time, inflated piece by piece."""
    rest = b""
    while True:
        rest = rest or stream.read(PIECE)
        if not rest:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := stream.read(PIECE)):
                raise ValueError("the archive ends inside a gzip member")
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(parts)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a member; the block is framed by Content-Length and two line ends must follow."""
    end = member.index(CRLF + CRLF)
    version, *lines = member[:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    start, length = end + 4, int(fields["Content-Length"])
    block = member[start : start + length]
    if len(block) != length or member[start + length :] != CRLF + CRLF:
        raise ValueError(f"{fields['WARC-Record-ID']}: the block does not end where Content-Length says")
    return fields, block


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:none>" else int(urn[len("<urn:page:") : -1])


def read_archive(stream) -> Iterator[dict]:
    """Records of an archive as page rows, every digest verified."""
    for member in members(stream):
        fields, block = parse_record(member)
        if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"{fields['WARC-Record-ID']}: the block digest differs")
        http, payload = block.split(CRLF + CRLF, 1)
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and (len(payload) != length or sha1_base32(payload) != digest):
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload digest differs")
        yield {"page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _page(fields.get("WARC-Refers-To"))}


def with_originals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex), length, refers_to (null for responses). Payloads of revisits are dropped.

    Payloads are equal if SHA-1, length and a second hash are. Repeated ones are found from these alone; payloads are
    not shuffled while the repeated ones are few enough to broadcast.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload")).withColumn("second", F.xxhash64("payload"))
    same = ["digest", "length", "second"]
    repeated = base.filter(F.col("length") >= least_bytes).groupBy(*same).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and first is not null")
    joined = base.join(sized(cut(repeated.drop("copies"), "repeated-payloads"), BROADCAST_PAYLOADS), same, "left")
    joined = joined.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    return joined.drop("first", "second").withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write archives of ``archive_bytes`` or so into ``path``; the table of them: archive, records, bytes."""
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        part, rows = TaskContext.get().partitionId(), []
        chunks, size, records = [], 0, 0

        def flush():
            uri = f"{path}/part-{part:06d}-{len(rows):04d}.warc.gz"
            rows.append({"archive": uri, "records": records, "bytes": write_file(uri, chunks)})

        for batch in batches:
            for x in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(x["digest"])).decode()
                chunks.append(record_bytes(x["page_id"], x["url"], x["payload"] or b"", x["length"], digest, x["refers_to"]))
                size, records = size + len(chunks[-1]), records + 1
                if size >= archive_bytes:
                    flush()
                    chunks, size, records = [], 0, 0
        if records:
            flush()
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    prepare(pages.sparkSession)
    dealt = with_originals(pages, **columns)
    return cut(dealt.mapInArrow(tidied(run), "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows of all records in the archives of ``manifest``: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, where = file_system(uri)
                rows, size = [], 0
                with fs.open_input_stream(where, compression=None) as stream:
                    for row in read_archive(stream):
                        rows.append(row)
                        size += 400 + len(row["payload"] or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = max(1, min(10_000, manifest.count()))
    return manifest.select("archive").repartition(tasks).mapInArrow(tidied(run), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc")))
