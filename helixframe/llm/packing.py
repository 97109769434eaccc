"""Sum-of-squares packing of tokenised documents into fixed-size sequences.

Only documents longer than the capacity are cut, into whole pieces; every
other piece is placed where the sum over residual gaps of the squared number
of open bins with that gap becomes smallest, longest pieces first; a bin is
opened only where none can take the piece.  Pieces are dealt at random to
groups whose number follows the total of tokens (``group_tokens`` each), so
that a group's task is bounded and its few last bins cost next to nothing.

Defined results: null or empty texts are the separator alone; null and
repeated ids are rows like any other; ties between gaps go to the smaller gap;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import LOWER, Spans, stored, text_chunks

CAPACITY = 2048
GROUP_TOKENS = 8 << 20
MEMO_WORDS = 600_000
LEARN = 4096  # words encoded at once

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,!?#$%&*;:()\""]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A, 0x0D, 0x09]] = True


class WordTokens:
    """Token ids of whole texts from a memo of word parts.

    The tokenizer drops white space and splits at every border between an
    ASCII letter and one of ``.,!?#$%&*;:()"``, so a text's ids are those of
    its parts one after the other.  Parts are encoded once per Python worker;
    texts that hold a special token's mark are encoded whole."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        sizes, parts = [], [self.pool]
        for s in range(0, len(words), LEARN):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[s:s + LEARN], add_special_tokens=False)]
            sizes += map(len, ids)
            parts.append(np.array([x for i in ids for x in i], np.uint32))
        n = np.array(sizes, np.int64)
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate(parts)
        order = np.argsort(k := np.concatenate([self.keys, keys]))
        self.keys, self.at, self.n = k[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text)."""
        raw = data.tobytes()
        if b"<|" in raw:
            texts = [raw[s:e].decode() for s, e in zip(offs[:-1], offs[1:])]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([y for x in ids for y in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        low = LOWER[data]
        cut = np.zeros(n + 1, bool)
        blank, letter, mark = _BLANK[data], _LETTER[data], _MARK[data]
        cut[1:n] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:]) | (blank[:-1] != blank[1:])
        cut[offs] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        keep = ~blank[start]
        start, end = start[keep], end[keep]
        h = Spans(low).hash(start, end)
        u, first, where = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_WORDS:
            self._forget()
        j = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[j] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            lowered = low.tobytes()
            self._learn(u[new], [lowered[s:e].decode() for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            j = np.searchsorted(self.keys, u)
        at, size = self.at[j][where], self.n[j][where]
        total = int(size.sum())
        base = np.cumsum(size) - size
        ids = self.pool[np.repeat(at - base, size) + np.arange(total)]
        border = np.searchsorted(start, offs)
        per = np.diff(np.concatenate([base, [total]])[border])
        return ids, per


_TOKENIZERS: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int, separator: int, with_tokens: bool):
    def run(batches):
        words = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokens(path))
        for rows, data, offs in text_chunks(batches, "t"):
            ids, per = words.encode(data, offs)
            at, out = 0, ([], [], [], [], [], [])
            sep = np.array([separator], "<u4")
            owners = rows.column("i").to_pylist()
            for d, k in zip(owners, per.tolist()):
                mine = np.append(ids[at:at + k].astype("<u4"), sep)
                at += k
                for p, s in enumerate(range(0, k + 1, capacity)):
                    raw = mine[s:s + capacity].tobytes()
                    for col, v in zip(out, (d, p, s, len(raw) // 4, zlib.crc32(raw), raw if with_tokens else None)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "tokens"])

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length, taken longest first."""
    open_bins = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        here = open_bins[size:]
        some = np.flatnonzero(here)
        if len(some):
            # the squares change by -2N[gap]+1, and by 2N[gap-size]+1 unless the bin is now full
            change = np.where(some == 0, 1 - 2 * here[some], 2 * (open_bins[some] - here[some] + 1))
            gap = int(some[np.argmin(change)]) + size
            b = waiting[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            waiting[gap - size].append(b)
    return bins, offsets


def _place(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        bins, offsets = sum_of_squares(table["length"].to_numpy(), capacity)
        group = int(table["g"][0].as_py())
        return (table.drop_columns(["g"]).append_column("sequence_id", pa.array(bins + (group << 32), pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         separator: int = 0, group_tokens: int = GROUP_TOKENS, with_tokens: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, tokens,
    sequence_id, offset`` (tokens: little-endian unsigned 32-bit ids, only
    ``with_tokens``).  ``tokenizer`` is the path of a tokenizer file that every
    executor has."""
    text = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, tokens binary"
    pieces = stored(text.mapInArrow(_pieces(tokenizer, capacity, separator, with_tokens), schema), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(_place(capacity), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, tokens, doc_ids``: the bytes of each sequence, from the
    result of :func:`pack` ``with_tokens``; a sequence is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "tokens", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p.tokens", F.lit(b""), lambda a, b: F.concat(a, b)).alias("tokens"), F.col("p.doc_id").alias("doc_ids"))
