"""WARC archives written from, and read back into, a chunked record table.

A payload is cut into chunks of ``CHUNK`` bytes.  A chunk is a row (record,
chunk number) and becomes one WARC record: the first a ``response``, the others
``continuation`` segments of it, as the format provides for oversized payloads.
Payloads are cut by the task that scans them, which carries the digest from
chunk to chunk; what is shuffled, joined to its decision, written and read are
chunks with the digest so far.  So no shuffled row, writer, reader or archive
member ever holds more than a chunk (the scan's row holds its text), and
archives stay small however large a payload is.  The reader hashes a record
of one chunk where it is read; longer ones are brought together by record,
sorted by chunk number, and hashed one chunk after the other as they arrive.

Each WARC record is a gzip member, as is usual.  Spark's text writer writes a
row's bytes as they are and a separator after them; the last byte of a member
(the highest byte of its 32-bit size) is always zero here, so a member goes
without it and the separator is that zero byte.

Of records with equal payloads (by SHA-1 and length) of at least ``least``
bytes, the one with the smallest page id is the response, the others are
revisits of it; smaller payloads are all responses.  A null payload counts as
empty.  Rows with equal ids and payloads are all responses, or all revisits.
A null id is smaller than none: such a row is a response only where no row
with an id has its payload.  An empty table makes no archives.  Only page_id,
url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelmill.llm.common import keep, prepare

CHUNK = 64 << 10
#: Records of an archive file.
PER_FILE = 800
READ_AT_ONCE = 64 << 10
CHUNKS = (
    "page_id long, payload_digest string, payload_bytes long, record_type string, refers_to long, chunk_no int, chunks int, so_far string, member binary"
)
CUT = "page_id long, url string, payload_digest string, payload_bytes long, chunk_no int, chunks int, so_far string, data binary"
PARTS = "record string, chunk_no int, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, data binary, verified boolean"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 40 bits (10 hex digits) make 8 characters."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _decisions(pages: DataFrame, least: int) -> DataFrame:
    """(_id, _digest, record_type, refers_to) of every payload of an id; only ids and digests are grouped."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    ids = pages.select("page_id", base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    ids = keep(ids.distinct(), "page-digests")
    first = ids.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("original"))
    typed = ids.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return typed.select(
        F.col("page_id").alias("_id"),
        F.col("payload_digest").alias("_digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("original")).alias("refers_to"),
    )


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per chunk, with the digest of the payload up to its end; a chunk's bytes are copied when it is put out."""
    rows, held = [], 0

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            view = memoryview(html.as_buffer() or b"") if html.is_valid else memoryview(b"")
            parts = [view[lo : lo + chunk] for lo in range(0, max(1, len(view)), chunk)]
            digest, so_far = hashlib.sha1(), []
            for part in parts:
                digest.update(part)
                so_far.append(base64.b32encode(digest.copy().digest()).decode("ascii"))
            for n, (part, state) in enumerate(zip(parts, so_far), 1):
                rows.append((page_id, url, so_far[-1], len(view), n, len(parts), state, bytes(part)))
                held += len(part)
                if held >= 4 << 20 or len(rows) >= 10_000:
                    yield batch_of()
                    rows, held = [], 0
    if rows:
        yield batch_of()


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _header(fields: dict[str, object]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n").encode("utf-8")


def _member(header: dict[str, object], *block: bytes | memoryview) -> bytes:
    """One WARC record as a gzip member, without its last byte."""
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = _header(header | {"Content-Length": sum(map(len, block))})
    out = b"".join([packed.compress(head), *map(packed.compress, block), packed.compress(b"\r\n\r\n"), packed.flush()])
    if out[-1]:
        raise ValueError("a chunk must be smaller than 16 MB")
    return out[:-1]


def chunk_table(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of ``pages`` (page_id, url, html): a row per chunk, with its WARC record as ``member``.

    ``so_far`` is the digest of the payload up to the end of the chunk, so that
    a reader may check and resume after any of them.
    """
    prepare(pages.sparkSession)
    kinds = StructType.fromDDL(CUT)
    schema = to_arrow_schema(kinds)
    cut = pages.select("page_id", "url", "html").mapInArrow(lambda batches: _cut(batches, chunk, schema), kinds)
    typed = _decisions(pages, least)
    ready = cut.join(typed, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")))
    again = F.col("record_type") == "revisit"
    ready = ready.filter(~again | (F.col("chunk_no") == 1)).withColumn("chunks", F.when(again, 1).otherwise(F.col("chunks")))
    made = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "data"]
            rows = [dict(zip(names, values)) for values in zip(*(batch.column(n).to_pylist() for n in names))]
            members = [
                _written(r, r["chunk_no"], r["chunks"], memoryview(batch.column("data")[i].as_buffer()), r["payload_bytes"]) for i, r in enumerate(rows)
            ]
            columns = [batch.column(f.name) if f.name != "member" else pa.array(members, f.type) for f in made]
            yield pa.RecordBatch.from_arrays(columns, schema=made)

    return ready.select("page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "chunk_no", "chunks", "so_far", "data").mapInArrow(write, CHUNKS)


def _written(row: dict, n: int, chunks: int, part: memoryview, total: int) -> bytes:
    name = _name(row["page_id"], row["payload_digest"])
    fields: dict[str, object] = {
        "WARC-Type": row["record_type"] if n == 1 else "continuation",
        "WARC-Record-ID": name if n == 1 else f"{name[:-1]}:{n}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", row["url"] or "urn:unknown"),
    }
    if chunks > 1:
        fields |= {"WARC-Segment-Number": n}
        fields |= {"WARC-Segment-Origin-ID": name} if n > 1 else {}
        fields |= {"WARC-Segment-Total-Length": total} if n == chunks else {}
    if n > 1:
        return _member(fields, part)
    fields["WARC-Payload-Digest"] = "sha1:" + row["payload_digest"]
    if row["record_type"] == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = _name(row["refers_to"], row["payload_digest"])
    else:
        fields["Content-Type"] = "application/http; msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode("ascii")
    return _member(fields, http, *([part] if row["record_type"] == "response" else []))


def write_archives(chunks: DataFrame, path: str) -> None:
    """Write the members of a chunked record table to gzip-compressed WARC files under ``path``."""
    members = chunks.select(F.col("member").cast("string").alias("member"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", PER_FILE).text(path)


def _records(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of the WARC records of an archive, decompressed little by little."""
    held, fed = bytearray(), 0
    unpack = zlib.decompressobj(31)

    def more() -> bool:
        nonlocal fed, unpack
        while True:
            data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            if not data:
                if fed >= len(content):
                    return False
                data = content[fed : fed + READ_AT_ONCE]
                fed += len(data)
            got = unpack.decompress(data, 4 * READ_AT_ONCE)
            if got:
                held.extend(got)
                return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = held[:end].decode("utf-8").split("\r\n")
        header = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(header["Content-Length"])
        while len(held) < stop + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        yield header, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def _page(name: str) -> int | None:
    number = name[1:-1].split(":")[2]
    return int(number) if number else None


def read_chunks(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives under ``path``: a row per chunk, with its payload bytes.

    Without ``payloads``, the payload of a record of one chunk is left out; it is verified where it was read.
    """
    prepare(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for header, block in _records(memoryview(content.as_buffer())):
                    rows.append(_chunk(header, block, payloads))
                    held += len(block)
                    if held >= 4 << 20:
                        yield _parts(rows)
                        rows, held = [], 0
                if rows:
                    yield _parts(rows)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(parse, PARTS)


def _chunk(header: dict[str, str], block: bytes, payloads: bool) -> tuple:
    n = int(header.get("WARC-Segment-Number", 1))
    if n > 1:
        return (header["WARC-Segment-Origin-ID"], n, None, None, None, None, None, block, False)
    name, kind = header["WARC-Record-ID"], header["WARC-Type"]
    at = block.index(b"\r\n\r\n") + 4
    total = int(re.search(rb"\r\nContent-Length: (\d+)", block[:at])[1])
    refers = _page(header["WARC-Refers-To"]) if kind == "revisit" else None
    row = (name, 1, _page(name), total, header["WARC-Payload-Digest"].removeprefix("sha1:"), kind, refers)
    if payloads or "WARC-Segment-Number" in header:
        return (*row, block[at:], False)
    _finished(row, hashlib.sha1(block[at:]), len(block) - at)
    return (*row, None, True)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    names = [f.split()[0] for f in PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are computed from its chunks, one at a time
    in order; a mismatch with what its header states is an error.
    """
    chunks = read_chunks(spark, path, payloads=False)
    ordered = chunks.repartition("record").sortWithinPartitions("record", "chunk_no")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, size, last, copies, done = None, None, 0, 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if head is None or row[0] != head[0]:
                    if head is not None:
                        done += [_finished(head, digest, size)] * copies
                    head, digest, size, last, copies = row, hashlib.sha1(), 0, 0, 0
                copies += row[1] == 1
                if row[1] == last:
                    continue  # the same chunk of an equal record
                last = row[1]
                if not row[8]:
                    digest.update(row[7])
                    size += len(row[7])
            if len(done) >= 4096:
                yield _results(done)
                done = []
        if head is not None:
            done += [_finished(head, digest, size)] * copies
        if done:
            yield _results(done)

    return ordered.mapInArrow(join, RESULT)


def _finished(head: tuple, digest, size: int) -> tuple:
    _, _, page_id, total, stated, kind, refers = head[:7]
    if kind == "response" and not (len(head) > 8 and head[8]):
        own = base64.b32encode(digest.digest()).decode("ascii")
        if (own, size) != (stated, total):
            raise ValueError(f"record {head[0]} does not have the payload that its header states")
    return (page_id, total, stated, kind, refers)


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
