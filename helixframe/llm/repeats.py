"""Exact repeated passages by a distributed, common-prefix-aware merge sort of
sampled suffixes.

A byte is removed when it is covered by a ``window``-byte string that also
starts earlier (in a smaller document id, or earlier in the same document).

1. *Sampling without loss.*  Every window has an anchor: the position in it
   whose 8 bytes have the smallest hash (leftmost on ties), with ``core``
   bytes after it still inside the window.  The anchor depends on the window's
   bytes alone, so equal windows have equal anchors at equal offsets and only
   anchors' suffixes need sorting (about one position in 35).  A window whose
   anchor's core occurs once in the corpus is not repeated; the hashes of all
   cores, dealt to shards by value, tell which occur again.
2. *Runs.*  Each block of documents sorts the suffixes at its surviving
   anchors (a suffix that recurs within the block with the same left context is
   settled there and not sent), and front-codes them: the length of the prefix
   shared with the suffix before, then the rest.
3. *Merge.*  Runs are cut at sampled splitters (never inside equal cores) and
   exchanged; each range is merged by a loser tree whose entries remember the
   prefix shared with the last output, so that a known prefix is never
   compared again.  Of suffixes with equal cores, in order of place, a window
   is repeated when its bytes were there before.
4. *Cut.*  Repeated windows come back to their documents as intervals.

Defined results: null texts are empty; texts shorter than the window keep all
bytes; rows of a null id, which have no place, are left out; rows that share
an id are one place apart only by offset, neither removes the other at the
same offset; other columns are ignored.
"""

from __future__ import annotations

import struct
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import long_ids, mix, pack, pack_sorted, shard_cuts, shards, stored, text_chunks, unpack, unpack_sorted, utf8

WINDOW, CORE = 100, 32
FLUSH = 2_000_000
RUN_CHUNK = 4096
SAMPLE = 8192


# ------------------------------------------------------------ anchors


def anchors(data: np.ndarray, offs: np.ndarray, window: int, core: int):
    """(anchor, first window, last window) for each run of windows of one
    document that share an anchor, and the anchors' core hashes."""
    n = len(data)
    if n < window:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    padded = np.concatenate([data, np.zeros(core + 16, np.uint8)])
    eight = np.empty(n + core, np.uint64)
    for r in range(8):
        v = np.frombuffer(padded, "<u8", (len(padded) - r) // 8, r)
        eight[r::8] = v[:len(eight[r::8])]
    key = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(n, dtype=np.uint64)
    reach, span = window - core + 1, 1
    while span * 2 <= reach:
        key = np.minimum(key[:len(key) - span], key[span:])
        span *= 2
    if span < reach:
        key = np.minimum(key[:len(key) - (reach - span)], key[reach - span:])
    long = np.flatnonzero(np.diff(offs) >= window)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, offs[long], 1)
    np.add.at(step, offs[long + 1] - window + 1, -1)
    p = np.flatnonzero(np.cumsum(step[:n]) > 0)
    if not len(p):
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    a = (key[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1
    at = a[head]
    h = np.zeros(len(at), np.uint64)
    for j in range(0, core, 8):
        h = mix(h * np.uint64(0xD1342543DE82EF95) + eight[at + j])
    return at, p[head], p[tail], h


def _core_messages(window: int, core: int, n: int):
    """Core hashes of each block, distinct within it, dealt to shards by value."""
    def send(blocks, hashes):
        h, b = np.concatenate(hashes), np.concatenate(blocks)
        order = np.lexsort((b, h))
        h, b = h[order], b[order]
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (b[1:] == b[:-1])])
        twice = np.concatenate([again[1:], [False]])
        h, b, twice = h[~again], b[~again], twice[~again]
        cuts = shard_cuts(h, n)
        full = [k for k in range(n) if cuts[k] < cuts[k + 1]]
        part = lambda x: pa.array([pack(x[cuts[k]:cuts[k + 1]]) for k in full], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([pack_sorted(h[cuts[k]:cuts[k + 1]]) for k in full], pa.binary()), part(b.astype(np.uint32)), part(twice.astype(np.uint8))],
            names=["shard", "h", "b", "twice"])

    def run(batches):
        blocks, hashes, held = [], [], 0
        for rows, data, offs in text_chunks(batches, "t"):
            _, first, _, h = anchors(data, offs, window, core)
            of = np.searchsorted(offs, first, "right") - 1
            blocks.append(long_ids(rows.column("block"))[of])
            hashes.append(h)
            held += len(h)
            if held >= FLUSH:
                yield send(blocks, hashes)
                blocks, hashes, held = [], [], 0
        if held:
            yield send(blocks, hashes)

    return run


def _recurring(table: pa.Table) -> pa.Table:
    """Of one shard, per block: the core hashes that occur more than once."""
    h = np.concatenate([unpack_sorted(x) for x in table["h"].to_pylist()])
    b = np.concatenate([unpack(x) for x in table["b"].to_pylist()])
    twice = np.concatenate([unpack(x) for x in table["twice"].to_pylist()]) > 0
    order = np.argsort(h, kind="stable")
    h, b, twice = h[order], b[order], twice[order]
    same = h[1:] == h[:-1]
    keep = twice | np.concatenate([[False], same]) | np.concatenate([same, [False]])
    # twice in one flush, once in another: both flushes' entries are of equal hash and kept
    h, b = h[keep], b[keep]
    order = np.lexsort((h, b))
    h, b = h[order], b[order]
    ids, start = np.unique(b, return_index=True)
    end = np.append(start[1:], len(b))
    return pa.table({"block": pa.array(ids.astype(np.int64), pa.int64()), "h": pa.array([pack_sorted(h[s:e]) for s, e in zip(start, end)], pa.binary())})


# --------------------------------------------------------------- runs


def shared_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    n = min(len(x), len(y))
    if x[known:n] == y[known:n]:
        return n
    d = int.from_bytes(x[known:n], "big") ^ int.from_bytes(y[known:n], "big")
    return n - (d.bit_length() + 7) // 8


_HEAD = struct.Struct("<BBBqqB")


def front_code(entries: list[tuple]) -> bytes:
    """Sorted (suffix, left, doc, at, windows) to bytes: each suffix as the
    length it shares with the one before and the rest."""
    out, before = [], b""
    for suffix, left, doc, at, windows in entries:
        c = shared_prefix(before, suffix)
        out += (_HEAD.pack(c, len(suffix) - c, len(left), doc, at, windows), suffix[c:], left)
        before = suffix
    return b"".join(out)


def front_decode(blob: bytes):
    """Entries with the prefix each shares with the one before it."""
    i, before, size = 0, b"", _HEAD.size
    while i < len(blob):
        c, rest, left, doc, at, windows = _HEAD.unpack_from(blob, i)
        i += size
        before = before[:c] + blob[i:i + rest]
        i += rest
        yield c, before, blob[i:i + left], doc, at, windows
        i += left


def _cuts_schema() -> str:
    return "kind int, block long, first binary, ids binary, starts binary, ends binary, run binary"


def _runs(window: int, core: int, blocks: int):
    """Of one block of documents: its sorted, front-coded run (kind 0) and the
    intervals settled within the block (kind 1)."""
    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows and found.num_rows:
            again = np.unique(np.concatenate([unpack_sorted(x) for x in found["h"].to_pylist()]))
            docs = docs.sort_by("i").combine_chunks()
            seen: dict[bytes, tuple] = {}
            gone: list[tuple[int, int, int]] = []
            for part, data, offs in text_chunks(docs.to_batches(), "t"):
                at, first, last, h = anchors(data, offs, window, core)
                j = np.minimum(np.searchsorted(again, h), len(again) - 1)
                hit = again[j] == h
                at, first, last = at[hit], first[hit], last[hit]
                of = np.searchsorted(offs, first, "right") - 1
                ids, raw, base = long_ids(part.column("i")), data.tobytes(), offs[:-1]
                for a, p, q, d in zip(at.tolist(), first.tolist(), last.tolist(), of.tolist()):
                    whole = raw[p:q + window]
                    k = whole + bytes((a - p,))
                    place = (int(ids[d]), a - int(base[d]))
                    before = seen.setdefault(k, place)
                    if before < place:
                        gone.append((place[0], p - int(base[d]), q + window - int(base[d])))
            entries = sorted((k[k[-1]:-1], k[:k[-1]], doc, at, len(k) - 1 - window + 1) for k, (doc, at) in seen.items())
            block = int(docs["block"][0].as_py())
            for i in range(0, len(entries), RUN_CHUNK):
                some = entries[i:i + RUN_CHUNK]
                rows.append((0, block, some[0][0][:core], None, None, None, front_code(some)))
            if gone:
                rows += _intervals(gone, blocks)
        return pa.Table.from_pylist([dict(zip(("kind", "block", "first", "ids", "starts", "ends", "run"), r)) for r in rows], _ARROW)

    return run


_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("first", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary()), ("run", pa.binary())])


def _intervals(gone: list[tuple[int, int, int]], blocks: int) -> list[tuple]:
    g = np.array(gone, np.int64)
    of = g[:, 0] % blocks
    out = []
    for b in np.unique(of):
        x = g[of == b]
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        out.append((1, int(b), None, pack(x[:, 0]), pack(x[:, 1].astype(np.int32)), pack(x[:, 2].astype(np.int32)), None))
    return out


# -------------------------------------------------------------- merge


class LoserTree:
    """Merges sorted runs of (prefix shared with the entry before, suffix,
    rest...).  Each run's head knows how many bytes it shares with the last
    output; of two heads the one that shares more is smaller, and only heads
    that share equally much are compared, from there on."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head: list = [None] * self.k
        self.lcp = [0] * self.k
        for i in range(self.k):
            self._next(i)
            self.lcp[i] = 0
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._seat(i)

    def _next(self, i: int) -> None:
        e = next(self.runs[i], None)
        self.head[i] = e
        self.lcp[i] = e[0] if e else -1

    def _wins(self, i: int, j: int) -> bool:
        """Does head i come before head j?  The loser learns its shared prefix."""
        x, y = self.lcp[i], self.lcp[j]
        if x != y:
            return x > y
        if x < 0:
            return i < j
        a, b = self.head[i][1], self.head[j][1]
        c = shared_prefix(a, b, x)
        first = a[c:c + 1] < b[c:c + 1] or a[c:c + 1] == b[c:c + 1] and i < j
        self.lcp[j if first else i] = c
        return first

    def _seat(self, i: int) -> None:
        """First round: play upwards until an empty place."""
        at = (i + self.k) // 2
        while at > 0:
            if self.loser[at] < 0:
                self.loser[at] = i
                return
            if self._wins(self.loser[at], i):
                self.loser[at], i = i, self.loser[at]
            at //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.k and self.head[w := self.loser[0]] is not None:
            yield self.lcp[w], *self.head[w][1:]
            self._next(w)
            i, at = w, (w + self.k) // 2
            while at > 0:
                if self._wins(self.loser[at], i):
                    self.loser[at], i = i, self.loser[at]
                at //= 2
            self.loser[0] = i


def _settle(group: list[tuple], window: int, gone: list) -> None:
    """Suffixes with equal cores, in order of place: which windows were there before."""
    group.sort(key=lambda e: (e[2], e[3]))
    whole: dict[tuple, tuple] = {}
    seen: dict[bytes, tuple] = {}
    for suffix, left, doc, at, windows in group:
        start, text, place = at - len(left), left + suffix, (doc, at)
        before = whole.setdefault((left, suffix), place)
        if before is not place:
            if before < place:
                gone.append((doc, start, start + windows - 1 + window))
            continue
        run = -1
        for w in range(windows):
            old = seen.setdefault(text[w:w + window], (doc, start + w))
            if old < (doc, start + w):
                if run < 0:
                    run = w
            elif run >= 0:
                gone.append((doc, start + run, start + w - 1 + window))
                run = -1
        if run >= 0:
            gone.append((doc, start + run, start + windows - 1 + window))


def _merged(window: int, core: int, blocks: int):
    def run(key, table):
        runs: dict[int, list] = {}
        for block, blob in zip(table["block"].to_pylist(), table["run"].to_pylist()):
            runs.setdefault(block, []).append(list(front_decode(blob)))

        def chain(pieces):
            before = b""
            for piece in sorted(pieces, key=lambda p: (p[0][1], p[-1][1])):
                yield (shared_prefix(before, piece[0][1]), *piece[0][1:])
                yield from piece[1:]
                before = piece[-1][1]

        gone: list[tuple[int, int, int]] = []
        rows, group = [], []
        for lcp, *e in LoserTree([chain(b) for b in runs.values()]):
            if lcp < core and group:
                if len(group) > 1:
                    _settle(group, window, gone)
                group = []
                if len(gone) >= FLUSH // 4:
                    rows, gone = rows + _intervals(gone, blocks), []
            group.append(tuple(e))
        if len(group) > 1:
            _settle(group, window, gone)
        if gone:
            rows += _intervals(gone, blocks)
        return pa.Table.from_pylist([dict(zip(("kind", "block", "first", "ids", "starts", "ends", "run"), r)) for r in rows], _ARROW)

    return run


def _split(splitters: list[bytes], core: int):
    """Cut run pieces at the splitters; equal cores stay together."""
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("range", "block", "run")}
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("run").to_pylist()):
                at: dict[int, list] = {}
                for e in front_decode(blob):
                    at.setdefault(bisect_left(splitters, e[1][:core]), []).append(e[1:])
                for r, some in at.items():
                    out["range"].append(r), out["block"].append(block), out["run"].append(front_code(some))
            yield pa.RecordBatch.from_arrays([pa.array(out["range"], pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["run"], pa.binary())], names=list(out))

    return run


# ---------------------------------------------------------------- cut


def _kept():
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kept", pa.binary())])

    def run(key, docs: pa.Table, cuts: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        cat = lambda c: np.concatenate([none, *(unpack(x) for x in cuts[c].to_pylist())])
        ids, s, e = cat("ids"), cat("starts"), cat("ends")
        order = np.lexsort((s, ids))
        ids, s, e = ids[order], s[order], e[order]
        out: list[list] = [[], [], [], [], []]
        data, offs = utf8(docs["t"]) if docs.num_rows else (none.astype(np.uint8), none[:1])
        for i, d in enumerate(docs["i"].to_pylist()):
            text = data[offs[i]:offs[i + 1]]
            lo, hi = np.searchsorted(ids, d), np.searchsorted(ids, d, "right")
            ss, ee = s[lo:hi], e[lo:hi]
            if len(ss):
                far = np.maximum.accumulate(ee)
                new = np.concatenate([[True], ss[1:] > far[:-1]])
                ss, ee = ss[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]
                stay = np.ones(len(text), bool)
                for x, y in zip(ss, ee):
                    stay[x:y] = False
                kept = text[stay].tobytes()
            else:
                kept = text.tobytes()
            for k, v in enumerate((d, len(text), ss.astype(np.int32), ee.astype(np.int32), kept)):
                out[k].append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, core: int = CORE) -> DataFrame:
    """``doc_id, n_bytes, starts, ends, kept``: the maximal removed runs of
    bytes and the remaining bytes of every document."""
    if core % 8 or not 8 <= core < window <= 240:
        raise ValueError("core must be a multiple of 8 below the window, the window at most 240")
    spark = docs.sparkSession
    n = shards(spark)
    text = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).withColumn("block", F.pmod("i", F.lit(n)))
    sent = text.mapInArrow(_core_messages(window, core, n), "shard int, h binary, b binary, twice binary")
    again = stored(sent.groupBy("shard").applyInArrow(_recurring, "block long, h binary"), "cores")
    runs = stored(text.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_runs(window, core, n), _cuts_schema()), "runs")
    pieces = runs.where("kind = 0").select("block", "first", "run")
    # a bounded sample of run pieces: SAMPLE prefixes of `core` bytes
    seen = sorted({bytes(r[0]) for r in pieces.select("first").orderBy(F.xxhash64("first", "block")).limit(SAMPLE).collect()})
    cuts = seen[::max(1, len(seen) // n)][1:] if seen else []
    dealt = pieces.mapInArrow(_split(cuts, core), "range int, block long, run binary")
    merged = stored(dealt.groupBy("range").applyInArrow(_merged(window, core, n), _cuts_schema()), "merged")
    gone = runs.where("kind = 1").unionByName(merged).select("block", "ids", "starts", "ends")
    return text.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(
        _kept(), "doc_id long, n_bytes long, starts array<int>, ends array<int>, kept binary")
