"""WARC archives in seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each holding whole WARC
records, followed by the public seekable-format footer: a skippable frame with
every frame's compressed and decompressed size.  The record index (a Parquet
table) maps each record id to its bundle, its frame's offset in the bundle and
its own offset inside the decompressed frame, so one record costs one ranged
read and one frame's decompression.

Payloads are never gathered by content: a row's digest decides its type by a
join with the digests seen more than once, and payloads are shuffled for that
only where these digests are too many to broadcast.
Writers name bundles by a fresh id and are known only through the index, so a
repeated or speculative task leaves at most an unlisted file behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import checked_broadcast, materialise, run_dir, shuffle_width

SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1  # fixed by the seekable format
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
INDEX = "page_id long, record_id string, bundle string, frame long, frame_at long, frame_bytes long, at long, length long"


def open_fs(uri: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


class BundleWriter:
    """Appends records to frames of about ``frame_bytes``; close() writes the seek table."""

    def __init__(self, sink, level: int = 3, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.pending, self.pending_bytes, self.at = [], 0, 0
        self.table: list[tuple[int, int]] = []
        self.placed: list[tuple] = []  # (key, frame, offset in frame, length) of the open frame
        self.ready: list[tuple] = []

    def add(self, key, record: bytes) -> None:
        self.placed.append((key, len(self.table), self.pending_bytes, len(record)))
        self.pending.append(record)
        self.pending_bytes += len(record)
        if self.pending_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        frame = self.compressor.compress(b"".join(self.pending))
        self.sink.write(frame)
        self.ready += [(key, k, self.at, len(frame), at, n) for key, k, at, n in self.placed]
        self.table.append((len(frame), self.pending_bytes))
        self.at += len(frame)
        self.pending, self.pending_bytes, self.placed = [], 0, []

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.sink.close()


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, decompressed bytes) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    rows = source.read_at(8 * count, size - 9 - 8 * count)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", rows):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(source, at: int, packed: int, plain: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(source.read_at(packed, at), max_output_size=plain)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    """The id of the one response with this payload, which its revisits name."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{page_id}/{digest}')}>"


def _clean(value: object) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to, date: str) -> tuple[str, bytes]:
    """(record id, one WARC/1.1 record).  A revisit carries no payload but names its digest and length."""
    revisit, digest = kind == "revisit", base32_sha1(payload)
    own = record_id(page_id, digest) if kind == "first" else f"<urn:uuid:{uuid.uuid4()}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url) if url else 'urn:page:' + str(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        head += [f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a decompressed frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = plain[end + 4 : end + 4 + int(headers["Content-Length"])]
        yield headers, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + len(block) + 4


def with_types(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, kind, refers_to): the smallest id of each payload is the response, null ids last.

    kind is first, revisit or small: payloads shorter than ``least_bytes`` are all
    responses.  Of rows equal in payload and smallest id one is the response, and
    the others revisit it.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    keyed = slim.withColumn("_key", F.sha2("payload", 256))
    counts = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("_key", "page_id").agg(F.count("*").alias("_n"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "_n")
    again = counts.groupBy("_key").agg(F.min(order).alias("_first"), F.sum("_n").alias("_all")).where("_all > 1")
    again = materialise(again.select("_key", F.col("_first.page_id").alias("_id"), (F.col("_first._n") > 1).alias("_tied")), "repeated-payloads")
    told = keyed.join(checked_broadcast(again, F.lit(128)), "_key", "left")
    lead = F.col("_tied").isNotNull() & F.col("page_id").eqNullSafe(F.col("_id"))
    kind = F.when(F.octet_length("payload") < least_bytes, "small").when(F.col("_tied").isNull() | lead, "first").otherwise("revisit")
    typed = lambda df, kind: df.select("page_id", "url", "payload", kind.alias("kind"), F.when(kind == "revisit", F.col("_id")).alias("refers_to"))
    if again.where("_tied").isEmpty():
        return typed(told, kind)
    # Rows of one payload and id are told apart by a number, which has to be written to stay.
    tied = materialise(told.where(lead & F.col("_tied")).withColumn("_row", F.monotonically_increasing_id()), "tied-pages")
    one = materialise(tied.groupBy("_key").agg(F.min("_row").alias("_one")), "tied-firsts")
    tied = tied.join(checked_broadcast(one, F.lit(128)), "_key")
    return typed(told.where(~(lead & F.coalesce("_tied", F.lit(False)))), kind).unionByName(typed(tied, F.when(F.col("_row") == F.col("_one"), "first").otherwise("revisit")))


def write_archives(typed: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 3, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the bundles and the record index; returns the index.  Rows are handled one by one, a frame at a time."""
    spark = typed.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        writer, name, sink = None, None, None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            key, frame, frame_at, frame_n, at, n = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in key], pa.int64()), pa.array([k[1] for k in key], pa.string()), pa.array([name] * len(key), pa.string())]
                + [pa.array(x, pa.int64()) for x in (frame, frame_at, frame_n, at, n)],
                names=[f.split()[0] for f in INDEX.split(", ")],
            )

        for batch in batches:
            for k in range(batch.num_rows):
                if writer is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    fs.create_dir(path, recursive=True)
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                    writer = BundleWriter(sink, level, frame_bytes)
                page_id, url, payload, kind, refers_to = (batch.column(c)[k].as_py() for c in range(5))
                own, body = record(page_id, url, payload.encode(), kind, refers_to, date)
                writer.add((page_id, own), body)
                if len(writer.ready) >= 4096:
                    yield rows(writer.ready)
                    writer.ready = []
                if writer.at >= BUNDLE_BYTES:
                    writer.close()
                    if writer.ready:
                        yield rows(writer.ready)
                    writer = None
        if writer is not None:
            writer.close()
            if writer.ready:
                yield rows(writer.ready)

    index = typed.select("page_id", "url", "payload", "kind", "refers_to").mapInArrow(write, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string, frame long"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that the index names, read through their seek tables.

    A response's digest and length are taken from the payload itself and must
    equal its headers'; a revisit's come from its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/{name}") as source:
                    for k, (at, packed, plain) in enumerate(seek_table(source, source.size())):
                        out = []
                        for h, payload in parse_records(read_frame(source, at, packed, plain)):
                            revisit = h["WARC-Type"] == "revisit"
                            n, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                            if not revisit and (len(payload), base32_sha1(payload)) != (n, digest):
                                raise ValueError(f"{name}: a payload doesn't match its digest")
                            key, to = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                            out.append((key and int(key), n, digest, h["WARC-Type"], to and int(to), h["WARC-Record-ID"], name, k))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    bundles = index.select("bundle").distinct()
    return bundles.repartition(shuffle_width(index.sparkSession)).mapInArrow(read, READ)


def lookup(folder: str, entry) -> tuple[dict[str, str], bytes]:
    """One record by its index row: one ranged read of its frame."""
    fs, path = open_fs(folder)
    with fs.open_input_file(f"{path}/{entry.bundle}") as source:
        plain = read_frame(source, entry.frame_at, entry.frame_bytes, seek_table(source, source.size())[entry.frame][2])
    return next(parse_records(plain[entry.at : entry.at + entry.length]))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages as records, read the archives back, one row per record.

    Null payload: empty.  Null url: a urn of the page.  Null page_id: the record
    has no id header and reads back null; it comes after all others of its payload.
    An empty table writes no bundle and gives no rows.  Repeated rows each get a
    record, one of them the response.  Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = run_dir(spark, "warc")
    index = write_archives(with_types(pages, least_bytes), folder)
    return read_archives(index, folder)
