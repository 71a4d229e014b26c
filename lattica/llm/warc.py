"""WARC archives: write whole-file gzip streams, normalise them to one member per record with a
sidecar offset index, and read records back through that index.

The normaliser takes a monolithic ``.warc.gz`` (one deflate stream over all records, or any
concatenation of members), inflates it once in bounded chunks, and rewrites every record as a
gzip member of its own, so that ``(offset, length)`` of the sidecar gives random access.

Files go to the shared folder, under names no other attempt uses; a lost or repeated task leaves
at most a file that no table names. Only paths travel through Spark.

Defined results: a null html is the empty payload; a null url or page id gives a record without
that header; of rows with equal payloads of at least ``min_dedup`` bytes those with the largest
page id are responses, all others revisits (a null id only if another row has one); rows that
repeat an id give one record each; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

CHUNK = 1 << 20
MAX_BROADCAST_DIGESTS = 500_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has no payload but keeps its length and digest as headers."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head.append(f"X-Refers-To-Page: {refers_to}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def mark_revisits(pages: DataFrame, min_dedup: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to of every page.

    Digests are counted before they are joined, so a digest of many copies costs one row per task.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("payload_digest", F.sha1("payload"))
    keyed = base.select("page_id", "payload_digest").where(F.length("payload") >= min_dedup)
    copies = (
        keyed.groupBy(F.col("payload_digest").alias("_lt_digest"))
        .agg(F.max("page_id").alias("_lt_top"), F.count("*").alias("_lt_n"))
        .where("_lt_n > 1 AND _lt_top IS NOT NULL")
        .drop("_lt_n")
    )
    copies = written(copies, "warc-copies")
    few = copies.count() <= MAX_BROADCAST_DIGESTS  # else the payloads are shuffled
    joined = base.join(F.broadcast(copies) if few else copies, (F.col("payload_digest") == F.col("_lt_digest")) & (F.length("payload") >= min_dedup), "left")
    again = F.col("_lt_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_lt_top"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_lt_top")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Write each partition's records as monolithic gzip archives; one row (path, records) per archive."""

    def work(batches):
        filesystem, root = _fs(folder)
        filesystem.create_dir(root, recursive=True)
        done, out = [], None

        def close():
            nonlocal out
            if out is not None:
                out[1].write(out[2].flush())
                out[1].close()
                done.append((f"{folder}/{out[0]}", out[3]))
                out = None

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, digest, kind, refers = (batch.column(i)[row].as_py() for i in range(6))
                if out is None:
                    name = f"crawl-{uuid.uuid4().hex}.warc.gz"
                    out = [name, filesystem.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(3, wbits=31), 0, 0]
                data = record_bytes(page_id, url, payload, digest, kind, refers)
                out[1].write(out[2].compress(data))
                out[3] += 1
                out[4] += len(data)
                if out[4] >= max_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    order = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    return records.select(*order).mapInArrow(work, "path string, records long")


def inflate(stream):
    """Chunks of the inflated data of a gzip stream of one or more members."""
    engine, begun = zlib.decompressobj(wbits=31), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            yield engine.decompress(data, CHUNK)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, CHUNK)
            data = b""
            if engine.eof:
                data = engine.unused_data
                engine, begun = zlib.decompressobj(wbits=31), False
    if begun:  # the last member never ended, even if all that came of it is whole records
        if rest := engine.flush():
            yield rest
        raise ValueError("truncated gzip stream")


class _Reader:
    """Bounded look-ahead over chunks: header blocks whole, bodies piecewise."""

    def __init__(self, chunks):
        self.chunks, self.buffer = chunks, bytearray()

    def _more(self) -> bool:
        for c in self.chunks:
            if c:
                self.buffer += c
                return True
        return False

    def header(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("truncated WARC header")
                return None
        head = bytes(self.buffer[: end + 4])
        del self.buffer[: end + 4]
        return head

    def body(self, n: int):
        while n:
            if not self.buffer and not self._more():
                raise ValueError("truncated WARC body")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC header: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def normalise_one(source: str, target: str) -> int:
    """Rewrite one archive as a member per record at ``target`` and its index at ``target.idx``."""
    in_fs, in_path = _fs(source)
    out_fs, out_path = _fs(target)
    offset, entries = 0, []
    with in_fs.open_input_stream(in_path, compression=None) as stream, out_fs.open_output_stream(out_path, compression=None) as out, out_fs.open_output_stream(f"{out_path}.idx", compression=None) as index:
        reader = _Reader(inflate(stream))
        while (head := reader.header()) is not None:
            fields = parse_header(head)
            member, length = zlib.compressobj(3, wbits=31), 0
            length += out.write(member.compress(head)) or 0
            for piece in reader.body(int(fields["content-length"]) + 4):
                length += out.write(member.compress(piece)) or 0
            length += out.write(member.flush()) or 0
            end = out.tell()
            entries.append(f"{offset}\t{end - offset}\t{fields['warc-type']}\t{fields.get('x-page-id', '')}\n")
            offset = end
            if len(entries) >= 4096:
                index.write("".join(entries).encode())
                entries.clear()
        index.write("".join(entries).encode())
    return offset


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive of ``path``; one row (path, bytes) per rewritten archive."""

    def work(batches):
        filesystem, root = _fs(folder)
        filesystem.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/member-{uuid.uuid4().hex}.warc.gz"
                size = normalise_one(source, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([size], pa.int64())], names=["path", "bytes"])

    return archives.select("path").mapInArrow(work, "path string, bytes long")


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, fetched member by member through the sidecar index.

    Payload lengths and digests of responses are taken from the bytes read and held against the headers.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def work(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, name = _fs(path)
                rows = []
                with filesystem.open_input_stream(f"{name}.idx", compression=None) as index:
                    entries = index.read().decode().splitlines()
                with filesystem.open_input_file(name) as data:
                    for entry in entries:
                        offset, length = map(int, entry.split("\t")[:2])
                        record = zlib.decompress(data.read_at(length, offset), wbits=31)
                        head, _, rest = record.partition(b"\r\n\r\n")
                        fields = parse_header(head)
                        block = rest[: int(fields["content-length"])]
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(fields["x-payload-length"])
                        if fields["warc-type"] == "response":
                            if size != len(payload) or digest != hashlib.sha1(payload).hexdigest():
                                raise ValueError(f"payload of {path} at {offset} does not match its header")
                        ids = [int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page")]
                        rows.append((ids[0], fields.get("warc-target-uri"), size, digest, fields["warc-type"], ids[1]))
                        if len(rows) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("path").mapInArrow(work, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives, read every record back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    width = max(2, spark.sparkContext.defaultParallelism)
    crawl = written(write_archives(mark_revisits(pages), f"{folder}/crawl"), "warc-crawl")
    members = written(normalise(crawl.repartition(4 * width), f"{folder}/members"), "warc-members")
    return read_records(members.repartition(4 * width))
