"""Katz backoff language model, fitted and evaluated over whole corpora.

P(w | h) = d_r c(h,w) / c(h)            for seen n-grams, r = c(h,w)
         = alpha(h) P(w | h')           for unseen ones,
where h' is h without its first word, down to P(w), with Good-Turing discounts d_r for r <= ``k`` (Katz's renormalised ratio; where
the counts of counts do not allow it, an absolute discount), and
alpha(h) = (1 - sum of seen P(. | h)) / (1 - sum of their P(. | h')), so that each
conditional sums to one exactly over the vocabulary and the unknown word.  A
context none of whose counts is discounted counts once more in the denominator,
which frees 1/(c(h)+1) of its mass.  Unigrams back off in the same way to one
unknown word.  Each document starts after a begin mark and ends with an end
token, which is counted; its first token has the begin mark alone as context.
The order is 2 or 3.

Everything is exchanged as packed arrays: documents are written once as blocks
of word codes; the vocabulary is counted in shards by word hash and answers
each block with ids and counts; pairs are counted in shards of their context,
which answer with counts and the context's backoff statistics, triples in shards
of their context pair, which send statistics of the contexts that a block backs
off from only; blocks then evaluate their tokens from the highest order down.  The tables (one row per
shard) are stored as Parquet partitioned by order.  All of them grow with the
corpus, none passes through the driver, which only sees counts of counts.

Defined results: null texts are empty and score their end token alone; with
nothing to learn from, all mass is the unknown word's; rows of a null id are
left out; rows that share an id are scored each by itself; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import long_ids, mix, pack, pack_sorted, shard_cuts, shards, stored, stored_by, text_chunks, unpack, unpack_sorted, word_hashes

BLOCK_TOKENS = 2_000_000
K = 5
UNKNOWN, BEGIN = 0xFFFFFFFF, 0xFFFFFFFE
END_HASH = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id: int, folds: int = 5, fold: int = 1) -> bool:
    """Rows whose crc32 of the id as text leaves ``fold`` are not learnt from."""
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """d_0..d_k (d_0 unused) from counts of counts n[1..k+1]; 1 = none."""
    d = np.ones(k + 1)
    if n[1] <= 0:
        return d
    tail = (k + 1) * n[k + 1] / n[1]
    if tail < 1 and all(n[r] > 0 for r in range(1, k + 1)):
        g = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in g):
            d[1:] = g
            return d
    b = n[1] / (n[1] + 2 * n[2]) if n[2] else 0.5
    d[1:] = [(r - b) / r for r in range(1, k + 1)]
    return d


class Unigram:
    """P(w) by count, and the unknown word's."""

    def __init__(self, total: int, n: list[int], k: int = K):
        self.d, self.k = discounts(n, k), k
        free = float(sum(n[r] * (1 - self.d[r]) * r for r in range(1, k + 1)))
        self.total = total if free > 0 else total + 1
        self.unknown = (free if free > 0 else 1.0) / self.total

    def p(self, count: np.ndarray) -> np.ndarray:
        c = count.astype(np.float64)
        d = np.where(count <= self.k, self.d[np.minimum(count, self.k)], 1.0)
        return np.where(count > 0, d * c / self.total, self.unknown)


# ------------------------------------------------------------ blocks


def _by_frequency(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by falling count (of equal ones the first), and the places by rank."""
    order = np.argsort(-count.astype(np.int64), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, order


def _blocks(folds: int, fold: int, tokens: int):
    """Whole documents as blocks: ids, tokens per document, the block's
    distinct words, their learnt counts and counts, and a word code per token: the
    word's rank by count, which packs better than its place."""
    names = ["block", "ids", "lens", "held", "words", "counts", "totals", "codes"]
    kinds = [pa.int64(), *[pa.binary()] * 7]

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0

        def emit(ids, lens, hashes):
            ids, lens, h = map(np.concatenate, (ids, lens, hashes))
            held = np.fromiter((held_out(i, folds, fold) for i in ids.tolist()), bool, len(ids))
            words, codes, total = np.unique(h, return_inverse=True, return_counts=True)
            learnt = np.repeat(~held, lens)
            counts = np.bincount(codes[learnt], minlength=len(words))
            row = [(part << 24) + seq, pack(ids), pack(lens.astype(np.int32)), pack(held.astype(np.uint8)), pack_sorted(words), pack(counts.astype(np.uint32)), pack(total.astype(np.uint32)),
                   pack(_by_frequency(total)[0][codes].astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

        ids, lens, hashes, held = [], [], [], 0
        for rows, data, offs in text_chunks(batches, "t"):
            h, per = word_hashes(data, offs)
            at = np.cumsum(per)
            ids.append(long_ids(rows.column("i")))
            lens.append(per + 1)
            hashes.append(np.insert(h, at, END_HASH))
            held += len(hashes[-1])
            if held >= tokens:
                yield emit(ids, lens, hashes)
                ids, lens, hashes, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield emit(ids, lens, hashes)

    return run, "block long, ids binary, lens binary, held binary, words binary, counts binary, totals binary, codes binary"


def _word_messages(n: int):
    def run(batches):
        for batch in batches:
            for block, w, c in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                w, c = unpack_sorted(w), unpack(c)
                cut = shard_cuts(w, n)
                full = [s for s in range(n) if cut[s] < cut[s + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([pack_sorted(w[cut[s]:cut[s + 1]]) for s in full], pa.binary()), pa.array([pack(c[cut[s]:cut[s + 1]]) for s in full], pa.binary())],
                    names=["shard", "block", "words", "counts"])

    return run


_REPLY = pa.schema([("ord", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("n", pa.list_(pa.int64()))])
_REPLY_SQL = "ord int, shard int, block long, a binary, b binary, c binary, d binary, n array<long>"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_REPLY)], schema=_REPLY)


def _count_words(n: int, k: int, keep: bool):
    """One shard of the vocabulary: its table (block -1) and an answer to each
    block, in the order of the words it asked for: ids and counts."""
    def run(table: pa.Table) -> pa.Table:
        shard, blocks = int(table["shard"][0].as_py()), table["block"].to_pylist()
        asked = [unpack_sorted(x) for x in table["words"].to_pylist()]
        words, where = np.unique(np.concatenate(asked), return_inverse=True)
        count = np.bincount(where, np.concatenate([unpack(x) for x in table["counts"].to_pylist()]), len(words)).astype(np.int64)
        known = count > 0
        local = _by_frequency(count)[0]  # small ids for frequent words; unknown ones come last
        if int(known.sum()) * n + shard >= BEGIN:
            raise OverflowError("the vocabulary needs wider word ids")
        ids = np.where(known, local * n + shard, UNKNOWN).astype(np.uint32)
        stats = [int(count.sum()), int(known.sum()), *(int((count == r).sum()) for r in range(1, k + 2))]
        j = int(np.searchsorted(words, END_HASH))
        ends = int(count[j]) if j < len(words) and words[j] == END_HASH else 0
        table = (pack_sorted(words[known]), pack(ids[known]), pack(count[known].astype(np.uint32)), None) if keep else [None] * 4
        rows = [(1, shard, -1, *table, [*stats, ends])]
        at = 0
        for block, w in zip(blocks, asked):
            x = where[at:at + len(w)]
            at += len(w)
            rows.append((1, shard, block, pack(ids[x]), pack(count[x].astype(np.uint32)), None, None, None))
        return _rows(rows)

    return run


def _named(block: dict, answers: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a block's distinct words (answers come by shard, and
    shards are ranges of the ascending word hashes)."""
    answers = sorted(answers, key=lambda r: r[0])
    cat = lambda j, t: np.concatenate([unpack(r[j]) for r in answers]) if answers else np.zeros(0, t)
    return cat(1, np.uint32), cat(2, np.uint32).astype(np.int64)


def _pairs(block: dict, ids: np.ndarray, learnt_only: bool = False):
    """(context id, word id) of every token as one integer."""
    codes, lens = _by_frequency(unpack(block["totals"]))[1][unpack(block["codes"])], unpack(block["lens"])
    w = ids[codes]
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.cumsum(lens) - lens] = BEGIN
    return (h.astype(np.uint64) << np.uint64(32)) | w, codes, lens


def _pair_messages(n: int):
    """Per context shard: a block's distinct pairs with their learnt counts
    and the counts of their words, and the contexts it needs."""
    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if blocks.num_rows:
            block = blocks.to_pylist()[0]
            ids, count = _named(block, list(zip(*(answers[c].to_pylist() for c in ("shard", "a", "b")))))
            pair, codes, lens = _pairs(block, ids)
            learnt = np.repeat(unpack(block["held"]) == 0, lens)
            u, where = np.unique(pair, return_inverse=True)
            c = np.bincount(where[learnt], minlength=len(u))
            word = np.zeros(len(u), np.int64)
            word[where] = count[codes]
            h, w = u >> np.uint64(32), u & np.uint64(UNKNOWN)
            shard = np.where(h == BEGIN, 0, h % np.uint64(n)).astype(np.int32)
            shard[h == UNKNOWN] = -1
            for s in np.unique(shard[shard >= 0]):
                x = shard == s
                y = x & (w != UNKNOWN)
                rows.append((2, int(s), block["block"], pack_sorted(u[y]), pack(c[y].astype(np.uint32)), pack(word[y].astype(np.uint32)), pack_sorted(np.unique(h[x])), None))
        return _rows(rows)

    return run


def _count_pairs(k: int, total: int, n1: list[int], keep: bool):
    """One shard of contexts: the merged pairs (block -1) and, for each block,
    the counts of its pairs and for its contexts how many followers occur
    r = 1..k times and the unigram mass of all followers."""
    def run(table: pa.Table) -> pa.Table:
        uni = Unigram(total, n1, k)
        shard = int(table["shard"][0].as_py())
        asked = [unpack_sorted(x) for x in table["a"].to_pylist()]
        got = [unpack(x) for x in table["b"].to_pylist()]
        word = [unpack(x) for x in table["c"].to_pylist()]
        pair, where = np.unique(np.concatenate(asked), return_inverse=True)
        count = np.bincount(where, np.concatenate(got), len(pair)).astype(np.int64)
        of = np.zeros(len(pair), np.int64)
        of[where] = np.concatenate(word)
        seen = count > 0
        ctx, at = np.unique(pair[seen] >> np.uint64(32), return_inverse=True)
        c = count[seen]
        few = np.zeros((k, len(ctx)), np.uint32)
        for r in range(1, k + 1):
            few[r - 1] = np.bincount(at[c == r], minlength=len(ctx))
        mass = np.bincount(at, uni.p(of[seen]), len(ctx))
        stats = [int(c.sum()), len(c), *(int((c == r).sum()) for r in range(1, k + 2))]
        rows = [(2, shard, -1, *((pack_sorted(pair[seen]), pack(c.astype(np.uint32))) if keep else (None, None)), None, None, stats)]
        i = 0
        for block, p, hs in zip(table["block"].to_pylist(), asked, table["d"].to_pylist()):
            hs = unpack_sorted(hs)
            j = np.minimum(np.searchsorted(ctx, hs), max(0, len(ctx) - 1))
            ok = ctx[j] == hs if len(ctx) else np.zeros(len(hs), bool)
            m = np.where(ok, few[:, j], 0).astype(np.uint32) if len(ctx) else np.zeros((k, len(hs)), np.uint32)
            b = np.where(ok, mass[j], 0.0) if len(ctx) else np.zeros(len(hs))
            rows.append((2, shard, block, pack(count[where[i:i + len(p)]].astype(np.uint32)), pack(b), pack(m.ravel()), None, None))
            i += len(p)
        return _rows(rows)

    return run


class _Second:
    """A block's distinct pairs ``u`` with their probability ``p``, learnt counts
    ``c`` and their context's denominator ``whole``; by token the place ``where``
    of its pair and the learnt count ``count`` of its word."""

    def __init__(self, block: dict, answers: pa.Table, n: int, k: int, total: int, n1: list[int], n2: list[int], begins: int):
        uni, d = Unigram(total, n1, k), discounts(n2, k)
        parts = list(zip(*(answers[c].to_pylist() for c in ("ord", "shard", "a", "b", "c"))))
        ids, count = _named(block, [r[1:] for r in parts if r[0] == 1])
        pair, codes, self.lens = _pairs(block, ids)
        cw = self.count = count[codes]
        u, where = self.u, self.where = np.unique(pair, return_inverse=True)
        h, w = u >> np.uint64(32), u & np.uint64(UNKNOWN)
        shard = np.where(h == BEGIN, 0, h % np.uint64(n)).astype(np.int64)
        shard[h == UNKNOWN] = -1
        c2 = np.zeros(len(u), np.int64)
        first = np.zeros(len(u), np.int64)
        first[where] = np.arange(len(where))
        prev = np.empty(len(codes), np.int64)
        prev[1:] = cw[:-1]
        prev[np.cumsum(self.lens) - self.lens] = begins
        ctx_count = prev[first]
        mass, freed = np.zeros(len(u)), np.zeros(len(u))
        lose = np.array([(1 - d[r]) * r for r in range(1, k + 1)])
        for o, s, a, b, m in parts:
            if o != 2:
                continue
            x = np.flatnonzero(shard == s)
            c2[x[w[x] != UNKNOWN]] = unpack(a)
            at = np.unique(h[x], return_inverse=True)[1]
            mass[x] = unpack(b)[at]
            freed[x] = (lose @ unpack(m).reshape(k, -1))[at]
        self.whole = np.where(freed > 0, ctx_count, ctx_count + 1)
        left = np.where(freed > 0, freed, 1.0) / self.whole
        alpha = np.where(h == UNKNOWN, 1.0, np.where(ctx_count > 0, left / (1 - mass), 1.0))
        self.p = np.where(c2 > 0, _discounted(c2, d, k) / self.whole, alpha * uni.p(cw[first]))
        self.c = c2


def _discounted(count: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    return np.where(count <= k, d[np.minimum(count, k)], 1.0) * count


class _Triples:
    """A block's distinct triples, as places of their context pair (``before``)
    and of their last pair (``pair``) in ``u``, by ascending context; ``where``
    has the triple of each token, -1 for the first of a document.

    A context that was never learnt has nothing to ask for; ``asked`` are the
    triples whose context and last pair were, ``ctx`` the contexts learnt,
    ``runs`` how many triples each asks for, and ``back`` tells which of them
    have other followers, too."""

    def __init__(self, two: _Second):
        inner = np.ones(len(two.where), bool)
        inner[np.cumsum(two.lens) - two.lens] = False
        at = np.flatnonzero(inner)
        key, self.where = np.unique(two.where[at - 1] * len(two.u) + two.where[at], return_inverse=True)
        self.tokens = at
        self.before, self.pair = key // max(1, len(two.u)), key % max(1, len(two.u))
        learnt = two.c[self.before] > 0
        self.asked = learnt & (two.c[self.pair] > 0)
        self.ctx, self.of = np.unique(self.before[learnt], return_inverse=True)
        asks = self.asked[learnt]
        self.runs = np.bincount(self.of[asks], minlength=len(self.ctx))
        self.back = np.bincount(self.of[~asks], minlength=len(self.ctx)) > 0
        self.learnt = np.flatnonzero(learnt)


def _triple_shard(contexts: np.ndarray, n: int) -> np.ndarray:
    return (mix(contexts) % np.uint64(n)).astype(np.int32)


_ASKED = "shard int, block long, contexts binary, runs binary, words binary, counts binary, lower binary, whole binary, back binary"


def _triple_messages(n: int, k: int, total: int, n1: list[int], n2: list[int], begins: int):
    """Per shard: a block's contexts of two words with the denominator of the
    second, and the triples' words, learnt counts and their last pairs' counts."""
    names = [c.split()[0] for c in _ASKED.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]

    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if blocks.num_rows:
            block = blocks.to_pylist()[0]
            two = _Second(block, answers, n, k, total, n1, n2, begins)
            three = _Triples(two)
            learnt = np.repeat(unpack(block["held"]) == 0, two.lens)[three.tokens]
            c = np.bincount(three.where[learnt], minlength=len(three.before))[three.asked]
            last = three.pair[three.asked]
            whole = np.zeros(len(three.ctx), np.int64)
            whole[three.of] = two.whole[three.pair[three.learnt]]
            contexts = two.u[three.ctx]
            shard = _triple_shard(contexts, n)
            of = np.repeat(shard, three.runs)
            for s in np.unique(shard):
                x, y = shard == s, of == s
                rows.append((int(s), block["block"], pack_sorted(contexts[x]), pack(three.runs[x].astype(np.uint32)), pack((two.u[last[y]] & np.uint64(UNKNOWN)).astype(np.uint32)),
                             pack(c[y].astype(np.uint32)), pack(two.c[last[y]].astype(np.uint32)), pack(whole[x].astype(np.uint32)), np.packbits(three.back[x]).tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def _count_triples(k: int, d2: np.ndarray, keep: bool):
    """One shard of context pairs: the merged triples (block -1: contexts, runs,
    words, counts) and, for each block, the counts of its triples, which contexts have
    counts of up to k, and of those that it backs off from the mass of their
    followers by the lower order and how many of them occur r = 1..k times."""
    def run(table: pa.Table) -> pa.Table:
        shard = int(table["shard"][0].as_py())
        asked = [unpack_sorted(x) for x in table["contexts"].to_pylist()]
        runs = [unpack(x).astype(np.int64) for x in table["runs"].to_pylist()]
        cat = lambda c: np.concatenate([unpack(x) for x in table[c].to_pylist()])
        ctx, place = np.unique(np.concatenate(asked), return_inverse=True)
        whole = np.ones(len(ctx), np.int64)
        whole[place] = cat("whole")
        every, where = np.unique((np.repeat(place, np.concatenate(runs)).astype(np.uint64) << np.uint64(32)) | cat("words"), return_inverse=True)
        count = np.bincount(where, cat("counts"), len(every)).astype(np.int64)
        lower = np.zeros(len(every), np.int64)
        lower[where] = cat("lower")
        seen = count > 0
        at, c = (every[seen] >> np.uint64(32)).astype(np.int64), count[seen]
        few = np.stack([np.bincount(at[c == r], minlength=len(ctx)) for r in range(1, k + 1)]).astype(np.uint32)
        mass = np.bincount(at, _discounted(lower[seen], d2, k) / whole[at], len(ctx))
        per = np.bincount(at, minlength=len(ctx))
        stats = [int(c.sum()), len(c), *(int((c == r).sum()) for r in range(1, k + 2))]
        merged = (pack_sorted(ctx[per > 0]), pack(per[per > 0].astype(np.uint32)), pack((every[seen] & np.uint64(UNKNOWN)).astype(np.uint32)), pack(c.astype(np.uint32))) if keep else [None] * 4
        rows = [(3, shard, -1, *merged, stats)]
        i = j = 0
        for block, m, back in zip(table["block"].to_pylist(), runs, table["back"].to_pylist()):
            x, got = place[i:i + len(m)], count[where[j:j + int(m.sum())]]
            i, j = i + len(m), j + len(got)
            b = x[_backs_off(m, got, np.unpackbits(np.frombuffer(back, np.uint8), count=len(m)) > 0)]
            rows.append((3, shard, block, pack(got.astype(np.uint32)), np.packbits(few[:, x].any(axis=0)).tobytes(), pack(mass[b]), pack(few[:, b].ravel()), None))
        return _rows(rows)

    return run


def _backs_off(runs: np.ndarray, counts: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Contexts with a follower that was not learnt after them."""
    return back | (np.bincount(np.repeat(np.arange(len(runs)), runs)[counts == 0], minlength=len(runs)) > 0)


def _third(two: _Second, answers: pa.Table, n: int, k: int, d: np.ndarray) -> np.ndarray:
    """Probability of every token of a block by the order 3."""
    three = _Triples(two)
    contexts = two.u[three.ctx]
    shard = _triple_shard(contexts, n)
    of = np.repeat(shard, three.runs)
    c3, some, mass, freed = np.zeros(len(of), np.int64), np.zeros(len(contexts), bool), np.zeros(len(contexts)), np.zeros(len(contexts))
    lose = np.array([(1 - d[r]) * r for r in range(1, k + 1)])
    for o, s, a, b, m, f in zip(*(answers[c].to_pylist() for c in ("ord", "shard", "a", "b", "c", "d"))):
        if o == 3:
            x, y = np.flatnonzero(shard == s), of == s
            c3[y] = unpack(a)
            some[x] = np.unpackbits(np.frombuffer(b, np.uint8), count=len(x)) > 0
            z = x[_backs_off(three.runs[x], c3[y], three.back[x])]
            mass[z] = unpack(m)
            freed[z] = lose @ unpack(f).reshape(k, -1)
    some &= bool((lose > 0).all())
    context_count = two.c[three.ctx]
    whole = np.where(some, context_count, context_count + 1)
    alpha = np.where(some, freed, 1.0) / whole / (1 - mass)
    count = np.zeros(len(three.before), np.int64)
    count[three.asked] = c3
    p = two.p[three.pair]
    x = three.learnt
    p[x] = np.where(count[x] > 0, _discounted(count[x], d, k) / whole[three.of], alpha[three.of] * p[x])
    out = two.p[two.where]
    out[three.tokens] = p[three.where]
    return out


def _score(n: int, k: int, total: int, vocabulary: int, n1: list[int], n2: list[int], begins: int, n3: list[int] | None = None):
    """log10 P of every token of a block, summed by document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return schema.empty_table()
        block = blocks.to_pylist()[0]
        two = _Second(block, answers, n, k, total, n1, n2, begins)
        p = two.p[two.where] if n3 is None else _third(two, answers, n, k, discounts(n3, k))
        lens, cw = two.lens, two.count
        start = np.cumsum(lens) - lens
        add = lambda x: np.add.reduceat(x, start)  # noqa: E731  no document is without its end token
        base = np.log10((cw + 0.5) / (total + 0.5 * (vocabulary + 1)))
        return pa.Table.from_arrays([
            pa.array(unpack(block["ids"]), pa.int64()), pa.array(unpack(block["held"]) > 0, pa.bool_()), pa.array(lens.astype(np.int64)), pa.array(add((cw > 0).astype(np.int64))),
            pa.array(np.full(len(lens), total, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))], schema=schema)

    return run


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, k: int = K,
                 block_tokens: int = BLOCK_TOKENS, order: int = 2, keep_model: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(scores, model).  scores: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``.  model: the stored count tables, one
    row per order and shard, packed: order 1 has word hashes, ids and counts;
    order 2 has (context id << 32 | word id) and counts; order 3 has contexts
    (word id << 32 | word id), their numbers of followers, followers' ids and counts.  Without ``keep_model`` only the scores
    are made, and the second is None."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    n = shards(spark)
    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    blocks = stored_by(text.mapInArrow(*_blocks(folds, fold, block_tokens)), "block", n, "blocks")
    asked = blocks.select("block", "words", "counts").mapInArrow(_word_messages(n), "shard int, block long, words binary, counts binary")
    vocab = stored(asked.groupBy("shard").applyInArrow(_count_words(n, k, keep_model), _REPLY_SQL), "vocabulary")
    stats = [F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(k + 3)]
    total, words, *n1, end = vocab.where("block = -1").agg(*stats, F.coalesce(F.sum(F.col("n")[k + 3]), F.lit(0))).first()
    n1 = [0, *n1]  # the end token's count is the number of documents learnt from
    named = vocab.where("block <> -1")
    sent = blocks.groupBy("block").cogroup(named.select("block", "shard", "a", "b").groupBy("block")).applyInArrow(_pair_messages(n), _REPLY_SQL)
    pairs = stored(sent.groupBy("shard").applyInArrow(_count_pairs(k, total, n1, keep_model), _REPLY_SQL), "pairs")
    _, _, *n2 = pairs.where("block = -1").agg(*stats).first()
    columns = ["block", "ord", "shard", "a", "b", "c", "d"]
    answers = named.unionByName(pairs.where("block <> -1")).select(columns)
    model, constants, n3 = vocab.where("block = -1").unionByName(pairs.where("block = -1")), (n, k, total, n1, [0, *n2], end), None
    if order == 3:
        sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_triple_messages(*constants), _ASKED)
        triples = stored(sent.groupBy("shard").applyInArrow(_count_triples(k, discounts([0, *n2], k), keep_model), _REPLY_SQL), "triples")
        _, _, *n3 = triples.where("block = -1").agg(*stats).first()
        answers, model, n3 = answers.unionByName(triples.where("block <> -1").select(columns)), model.unionByName(triples.where("block = -1")), [0, *n3]
    scores = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(n, k, total, words, n1, [0, *n2], end, n3), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    model = model.select(F.col("ord").alias("order"), "shard", F.col("a").alias("keys"), "b", "c", "d")
    return scores, model if keep_model else None
