"""Helpers shared by the operators: shared scratch tables, byte buffers of
Arrow strings, packed integer arrays and vectorised word hashing.

The Python side of an operator works on whole Arrow batches with numpy; what
moves between tasks is moved by Spark as rows that hold packed arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from helixframe.session import ensure_checkpoint_dir

_SCRATCH: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below the folder that ``spark.checkpoint.dir`` names
    (shared by the driver and all executors)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it again:
    the lineage is cut and what was computed survives the loss of executors."""
    spark = df.sparkSession
    path = path or scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """:func:`stored` in ``buckets`` by ``key``: groups by it are read in place, not exchanged."""
    spark = df.sparkSession
    name = f"llm_{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", scratch(spark, tag)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name; the files stay
    return out


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a scratch folder that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def release(spark: SparkSession) -> int:
    """Delete the scratch tables of earlier operator calls; call it once
    their results are written.  Returns how many folders were removed."""
    n = 0
    while _SCRATCH:
        n += remove(spark, _SCRATCH.pop())
    return n


def shards(spark: SparkSession) -> int:
    """How many shards messages are dealt to: the session's shuffle
    partitions, which the deployment sizes by the data, raised to a prime so
    that patterned ids spread."""
    n = max(3, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


# ---------------------------------------------------------------- arrays


def pack(a: np.ndarray) -> bytes:
    """Bytes of an integer or float array: byte planes, then Zstandard."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.size else b""
    return a.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(planes)


def pack_sorted(a: np.ndarray) -> bytes:
    """:func:`pack` of the differences of an ascending uint64 array."""
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    kind = np.dtype(bytes(b[:4]).strip().decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shard_cuts(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Positions that cut ascending uint64 hashes into n equal ranges."""
    edges = np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


# ----------------------------------------------------------------- texts


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(kind).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_chunks(batches, text: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about ``limit`` text bytes: (rows, bytes,
    offsets).  A longer text is a slice of its own; no text is cut."""
    for batch in batches:
        data, offs = utf8(batch.column(text))
        i, n = 0, len(offs) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            i = j


_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            a = np.full(n + (n >> 3), b, np.uint64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=np.uint64)
    return _POWERS


class Spans:
    """Hashes of any byte spans of one buffer, from one prefix pass."""

    def __init__(self, data: np.ndarray):
        self._power = _powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self._power[0][:len(data)], out=self._sum[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._power[1][start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each white-space delimited word, and how many words
    each text has.  Words never cross the end of a text."""
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    if len(edge):
        cut = edge[inside[edge] & inside[edge - 1]]
        first[cut] = True
        last[cut - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    per = np.diff(np.searchsorted(start, offs))
    return start, end, per


def word_hashes(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word with A-Z lowered, and words per text."""
    low = LOWER[data]
    start, end, per = word_spans(low, offs, space)
    return Spans(low).hash(start, end), per


def long_ids(column) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)
