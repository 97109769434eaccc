"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_bytes``; after
the last frame comes a skippable frame with the seek table (compressed and
decompressed size of each frame) and its footer, in the public seekable
format, so that any frame can be read alone and a plain decompressor reads
the whole archive.  An index maps each record's id to its frame and offset.

Of records with equal payloads (of at least ``least`` bytes) the one of the
largest id is stored as ``response``; the others are ``revisit`` records
without a payload that refer to it.  Payloads are compared by length and
SHA-256.

Each task writes archives of its own under names that no other attempt uses;
the stored index names only those of tasks that ended well, so that a lost
executor leaves nothing but unnamed files.

Defined results: a null payload is empty; a null url is empty; records of a
null id are written but referred to by none, and never refer; rows that share
an id are a record each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import scratch, stored

FRAME, ARCHIVE = 1 << 20, 64 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"

INDEX = "archive string, frame int, at long, packed int, page_id long, offset long, length long"
_INDEX = pa.schema([("archive", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("packed", pa.int32()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, sha1: str, size: int) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit without payload."""
    clean = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    return "\r\n".join([*lines, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def records(frame: bytes):
    """(headers, payload) of each record of a decompressed frame."""
    i = 0
    while i < len(frame):
        end = frame.index(b"\r\n\r\n", i)
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in frame[i:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        yield head, frame[end + 4:end + 4 + n]
        i = end + 4 + n + 4


class Bundle:
    """One archive being written."""

    def __init__(self, folder: str):
        import zstandard

        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, where = _open(self.path)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(where, compression=None)  # frames are compressed here, one by one
        self.packer = zstandard.ZstdCompressor(level=3)
        self.at, self.sizes, self.held, self.size, self.ids = 0, [], [], 0, []

    def add(self, page_id, data: bytes) -> None:
        self.ids.append((page_id, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def frame(self) -> list[tuple]:
        """End the frame; its index rows."""
        packed = self.packer.compress(b"".join(self.held))
        self.out.write(packed)
        rows = [(self.path, len(self.sizes), self.at, len(packed), *x) for x in self.ids]
        self.sizes.append((len(packed), self.size))
        self.at += len(packed)
        self.held, self.size, self.ids = [], 0, []
        return rows

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.out.close()


def seek_table(path: str) -> list[tuple[int, int, int]]:
    """(place, compressed, decompressed size) of each frame, from the footer."""
    system, where = _open(path)
    with system.open_input_file(where) as f:
        end = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        table, at, out = f.read_at(8 * n, end - 9 - 8 * n), 0, []
        for packed, plain in struct.iter_unpack("<II", table):
            out.append((at, packed, plain))
            at += packed
        return out


def read_frame(path: str, at: int, packed: int) -> bytes:
    import zstandard

    system, where = _open(path)
    with system.open_input_file(where) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(packed, at))


def _write(folder: str, frame_bytes: int, archive_bytes: int):
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_INDEX)], schema=_INDEX)

    def run(batches):
        bundle = None
        for batch in batches:
            cols = [batch.column(c) for c in ("i", "u", "h", "sha1", "size", "refers")]
            for r in range(batch.num_rows):
                i, u, h, sha1, size, refers = (c[r].as_py() for c in cols)
                bundle = bundle or Bundle(folder)
                bundle.add(i, record(i, u, h, refers, sha1, size))
                if bundle.size >= frame_bytes:
                    yield batch_of(bundle.frame())
                    if bundle.at >= archive_bytes:
                        bundle.close()
                        bundle = None
        if bundle:
            if bundle.held:
                yield batch_of(bundle.frame())
            bundle.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0,
                   frame_bytes: int = FRAME, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write archives below ``folder`` (a path that all executors share) and
    return the stored index: ``archive, frame, at, packed, page_id, offset, length``."""
    empty = F.encode(F.lit(""), "UTF-8")
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), empty)
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("u"), payload.alias("h"))
    key = rows.select("i", F.sha2("h", 256).alias("k"), F.octet_length("h").alias("size"))
    main = key.where(F.col("size") >= least).groupBy("k", "size").agg(F.max("i").alias("main"), F.count("*").alias("c")).where("c > 1").drop("c")
    named = rows.withColumn("k", F.sha2("h", 256)).withColumn("size", F.octet_length("h")).join(main, ["k", "size"], "left")
    refers = F.when(F.col("i") != F.col("main"), F.col("main"))
    body = F.when(refers.isNull(), F.col("h")).otherwise(empty)
    sent = named.select("i", "u", body.alias("h"), _base32(F.sha1("h")).alias("sha1"), "size", refers.alias("refers"))
    return stored(sent.mapInArrow(_write(folder, frame_bytes, archive_bytes), INDEX), "warc-index")


def _base32(hex_digest):
    """Base 32 of 40 hexadecimal digits: eight groups of five digits (20 bits)."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for g in range(0, 40, 5):
        n = F.conv(F.substring(hex_digest, g + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.pmod(F.shiftright(n, s), F.lit(32)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _frames(batches):
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            t = seek_table(path)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(t)), pa.array([x[0] for x in t], pa.int64()), pa.array([x[1] for x in t], pa.int32())], names=["archive", "at", "packed"])


def _read(batches):
    for batch in batches:
        for path, at, packed in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "packed"))):
            out: list[list] = [[] for _ in range(7)]
            for head, payload in records(read_frame(path, at, packed)):
                name = lambda k: (lambda x: int(x) if x else None)(head.get(k, "<urn:page:>")[10:-1])  # noqa: B023, E731
                kind = head["WARC-Type"]
                whole = kind == "response"
                for c, v in zip(out, (name("WARC-Record-ID"), kind, head["WARC-Target-URI"], payload, len(payload) if whole else int(head["WARC-Payload-Length"]),
                                      digest(payload) if whole else head["WARC-Payload-Digest"][5:], None if whole else name("WARC-Refers-To"))):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"])


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives named in column ``archive``: ``page_id,
    record_type, url, payload, payload_bytes, payload_digest, refers_to``.
    Frames come from the archives' own seek tables and are read each by itself."""
    frames = archives.select("archive").distinct().mapInArrow(_frames, "archive string, at long, packed int")
    return frames.repartition(F.xxhash64("archive", "at")).mapInArrow(
        _read, "page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def read_record(index_row) -> tuple[dict, bytes]:
    """One record by its index row: reads and opens its frame only."""
    frame = read_frame(index_row["archive"], index_row["at"], index_row["packed"])
    return next(records(frame[index_row["offset"]:index_row["offset"] + index_row["length"]]))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages' archives to the shared scratch folder and read them back."""
    return read_archives(write_archives(pages, scratch(pages.sparkSession, "warc"), **options))
