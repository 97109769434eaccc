"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of
trusted text gives each document a perplexity, and quantiles of it by language
give the thresholds.

Fit: all trusted documents are used, one half by hash of the id for the counts,
the other, which the model has not seen, for the thresholds.  Raw trigram counts and the continuation counts of lower orders
are joined with their context's totals and stored in shards by n-gram hash,
as many as the text learnt from needs.
Score: blocks of whole documents ask the shards for their distinct n-grams and
evaluate order 3 down to the uniform floor for unknown words.  The driver sees
counts of counts and a filter of 8 MiB, which spares asking for most n-grams
that the model does not have.

The score of a document is its mean log10 probability per word, shrunk towards
its language's mean by ``prior`` words so that a few words do not decide; the
perplexity is 10 to minus that.  A document is rejected above the ``quantile``
of the calibrating documents of its language (of all, where a language has
fewer than ``least``) times 10 ** ``margin``.

Defined results: null and blank texts have no words, a null perplexity and are
rejected; a null language is a language of its own; null ids are scored and
returned; rows that share an id are scored each by itself and trusted alike;
without trusted documents nothing is rejected but blank texts; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import Spans, mix, pack, pack_sorted, remove, scratch, shards, stored, stored_by, text_chunks, unpack, unpack_sorted, word_spans

SHARD_BYTES = 2 << 20  # text learnt from per shard
SHARD_BITS, MOST_BITS, FILTER_BITS = 6, 16, 26  # at least 64 shards; the filter has a bit for 2 ** 26 ranges of hashes
BLOCK_BYTES, ASKED_BLOCKS = 4 << 20, 64
SENT = np.uint64(18)  # requests leave out the last bits of a hash: 46 tell n-grams apart
BROADCAST_IDS = 500_000  # more trusted ids than these are joined by a shuffle
QUANTILE, MARGIN, PRIOR, LEAST = 0.995, 0.05, 20.0, 50
_TWO, _THREE = 0xD1342543DE82EF95, 0xAEF17502108EF2D9
_B1, _B2 = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


def _grams(data: np.ndarray, offs: np.ndarray):
    """Hashes by token: word, previous word, bigram, its context bigram, trigram; and words per text."""
    start, end, per = word_spans(data, offs)
    w = Spans(data).hash(start, end)
    head = (np.cumsum(per) - per)[per > 0]
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[head] = _B1
    two = mix(v * np.uint64(_TWO) + w)
    before = np.empty_like(w)
    before[1:] = two[:-1]
    before[head] = _B2
    three = mix(before * np.uint64(_THREE) + w)
    return w, v, two, before, three, per


def _count(batches):
    """Distinct (context bigram, word) of some texts, with the context's last word."""
    for _, data, offs in text_chunks(batches, "t"):
        w, v, two, before, three, _ = _grams(data, offs)
        u, at, n = np.unique(three, return_index=True, return_counts=True)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (before[at], v[at], w[at], n)], names=["c", "v", "w", "n"])


def _with_totals(table: DataFrame, context: str) -> DataFrame:
    """Counts ``n`` with their context's total and how many of its counts are
    1, 2 and more; one row of each context is marked ``head``."""
    whole = Window.partitionBy(context)
    some = lambda x: F.sum(x.cast("int")).over(whole)
    return table.select("*", F.sum("n").over(whole).alias("total"), some(F.col("n") == 1).alias("n1"), some(F.col("n") == 2).alias("n2"), some(F.col("n") > 2).alias("n3"),
                        (F.row_number().over(whole.orderBy("w")) == 1).alias("head"))


def _discounts(table: DataFrame) -> list[float]:
    n1, n2, n3, n4 = (x or 0 for x in table.agg(*[F.sum((F.col("n") == r).cast("long")) for r in (1, 2, 3, 4)]).first())
    if not (n1 and n2 and n3 and n4):
        return [0.0, 0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(min(max(r - (r + 1) * y * b / a, 0.05), r - 0.05) for r, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]


#: What the model keeps of an n-gram: its count; as a context, the total of its
#: counts and how many of them are 1, 2 and more.
STATS = ("n", "own", "n1", "n2", "n3")
MESSAGE_ROWS = 400_000


def _messages(factor: int | None, bits: int):
    """Model rows (context c, word w, statistics) as packed arrays by shard;
    the n-gram's hash is that of (c, w), or w alone without a ``factor``."""
    def flush(parts):
        key = np.concatenate([p[0] for p in parts])
        stats = [np.concatenate([p[1 + k] for p in parts]) for k in range(len(STATS))]
        order = np.argsort(key)
        key, stats = key[order], [x[order] for x in stats]
        cut = np.searchsorted(_shard_of(key, bits), np.arange((1 << bits) + 1))
        full = np.flatnonzero(np.diff(cut)).tolist()
        packed = [[pack_sorted(key[cut[s]:cut[s + 1]]) for s in full], *([pack(x[cut[s]:cut[s + 1]]) for s in full] for x in stats)]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["shard", "keys", *STATS])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            get = lambda x: batch.column(x).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            c, w = get("c").view(np.uint64), get("w").view(np.uint64)
            zero = np.zeros(len(w), np.int32)
            parts.append([w if factor is None else mix(c * np.uint64(factor) + w), get("n").astype(np.int32), zero, zero, zero, zero])
            head = get("head")
            if head.any():
                zero = zero[head]
                parts.append([c[head], zero, *(get(x)[head].astype(np.int32) for x in ("total", "n1", "n2", "n3"))])
            held += len(w)
            if held >= MESSAGE_ROWS:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


_PACKED = ", ".join(f"{c} binary" for c in ("keys", *STATS))


def _shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32)


def _pack_shard(bits: int):
    """A shard of the model as one row: ascending keys, their statistics, and which slots of the filter they use."""
    return lambda table: _packed_shard(table, bits)


def _packed_shard(table: pa.Table, bits: int) -> pa.Table:
    every = np.concatenate([unpack_sorted(b) for b in table["keys"].to_pylist()])
    keys, at = np.unique(every, return_inverse=True)
    stats = [np.bincount(at, np.concatenate([unpack(b) for b in table[c].to_pylist()]), len(keys)).astype(np.int32) for c in STATS]
    slots = np.zeros(1 << (FILTER_BITS - bits), bool)
    slots[((keys >> np.uint64(64 - FILTER_BITS)) & np.uint64((1 << (FILTER_BITS - bits)) - 1)).astype(np.int64)] = True
    row = [pack_sorted(keys), *map(pack, stats), np.packbits(slots).tobytes()]
    return pa.Table.from_arrays([pa.array([table["shard"][0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=["shard", "keys", *STATS, "slots"])


class Found:
    """Statistics of some n-grams by ascending key, and the model's constants:
    discounts of orders 1 to 3, the floor of unknown words, and all word types' counts."""

    def __init__(self, keys: np.ndarray, stats: list[np.ndarray], constants: tuple):
        *self.discounts, self.floor, self.words = constants
        self.keys, self.stats = keys, dict(zip(STATS, stats))

    def look(self, q: np.ndarray, *names: str) -> list[np.ndarray]:
        """Statistics of n-grams; 0 where they were never seen."""
        if not len(self.keys):
            return [np.zeros(len(q), np.int32) for _ in names]
        j = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
        hit = self.keys[j] == q
        return [np.where(hit, self.stats[c][j], 0) for c in names]

    def share(self, q: np.ndarray, total, order: int) -> np.ndarray:
        """Discounted share of an n-gram in its context."""
        n = self.look(q, "n")[0]
        return np.where(n > 0, (n - np.array(self.discounts[order - 1])[np.minimum(n, 3)]) / np.maximum(total, 1), 0.0)

    def mixed(self, q: np.ndarray, context: np.ndarray, order: int, lower: np.ndarray) -> np.ndarray:
        """Probability of an n-gram after its context, given that of the lower order."""
        own, *n = self.look(context, "own", "n1", "n2", "n3")
        left = np.where(own > 0, sum(x * d for x, d in zip(n, self.discounts[order - 1][1:])) / np.maximum(own, 1), 1.0)
        return self.share(q, own, order) + left * lower

    def logp(self, w, v, two, before, three) -> np.ndarray:
        p = self.share(w, self.words, 1) + self.floor
        return np.log10(self.mixed(three, before, 3, self.mixed(two, v, 2, p)))


class Model:
    """A stored table with one packed row per shard of n-gram hashes, the
    constants of :class:`Found`, and a filter of fixed size that names nearly all absent n-grams."""

    def __init__(self, table: DataFrame, constants: tuple, bits: int):
        self.table, self.constants, self.bits = table, constants, bits
        slots = np.zeros((1 << bits, 1 << (FILTER_BITS - bits) >> 3), np.uint8)
        for r in table.select("shard", "slots").toLocalIterator():
            slots[r.shard] = np.frombuffer(r.slots, np.uint8)
        self.slots = slots.ravel()

    def logp(self, *grams) -> np.ndarray:
        """log10 probabilities of a few tokens, from the shards that have their n-grams."""
        shard = np.unique(_shard_of(np.concatenate(grams), self.bits)).tolist()
        rows = sorted(self.table.where(F.col("shard").isin(shard)).select("shard", "keys", *STATS).collect())
        return Found(np.concatenate([unpack_sorted(r.keys) for r in rows]), [np.concatenate([unpack(r[c]) for r in rows]) for c in STATS], self.constants).logp(*grams)


def fit(trusted_docs: DataFrame, bits: int = SHARD_BITS) -> Model | None:
    """The model of a set of texts in column ``t`` in ``2 ** bits`` shards; all counts and tables stay
    in Spark.  One exchange by context serves an order's counts and totals."""
    spark = trusted_docs.sparkSession
    counts = scratch(spark, "counts")
    raw = trusted_docs.select("t").mapInArrow(_count, "c long, v long, w long, n long")
    tri = raw.repartition("c").groupBy("c", "w").agg(F.sum("n").alias("n"), F.min("v").alias("v"))
    tri = stored(_with_totals(tri, "c").sortWithinPartitions("c"), "trigrams", f"{counts}/trigrams")
    bi = tri.select(F.col("v").alias("c"), "w").repartition("c").groupBy("c", "w").agg(F.count("*").alias("n"))
    bi = stored(_with_totals(bi, "c").sortWithinPartitions("c"), "bigrams", f"{counts}/bigrams")
    uni = stored(bi.groupBy("w").agg(F.count("*").alias("n")), "words", f"{counts}/words")
    total, words = uni.agg(F.sum("n"), F.count("*")).first()
    if not words:
        return None
    d = [_discounts(t) for t in (uni, bi, tri)]
    free = uni.agg(F.sum(F.when(F.col("n") == 1, d[0][1]).when(F.col("n") == 2, d[0][2]).otherwise(d[0][3]))).first()[0]
    zero = [F.lit(0).cast("long").alias(c) for c in ("n1", "n2", "n3")]
    alone = uni.select(F.col("w").alias("c"), "w", "n", F.lit(0).cast("long").alias("total"), *zero, F.lit(False).alias("head"))
    columns, schema = ["c", "w", "n", "total", "n1", "n2", "n3", "head"], f"shard int, {_PACKED}"
    every = tri.select(columns).mapInArrow(_messages(_THREE, bits), schema)
    for table, factor in ((bi.select(columns), _TWO), (alone, None)):
        every = every.unionByName(table.mapInArrow(_messages(factor, bits), schema))
    table = stored(every.groupBy("shard").applyInArrow(_pack_shard(bits), f"shard int, {_PACKED}, slots binary"), "model")
    remove(spark, counts)  # the model has all of it
    return Model(table, (*d, free / total / (words + 1), total), bits)


# --------------------------------------------------------------- scoring


def _blocks(batches):
    """Whole documents as blocks: ids, languages, text lengths, and the texts."""
    import zstandard
    from pyspark import TaskContext

    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def emit():
        rows = pa.Table.from_batches([r for r, _, _ in held])
        data, lens = np.concatenate([d for _, d, _ in held]), np.concatenate([np.diff(o) for _, _, o in held])
        lists = [pa.array([rows[c].to_pylist()], t) for c, t in (("i", pa.list_(pa.int64())), ("l", pa.list_(pa.string())))]
        return pa.RecordBatch.from_arrays([pa.array([(part << 24) + seq]), *lists, pa.array([pack(lens)], pa.binary()), pa.array([zstandard.ZstdCompressor(level=9).compress(data.tobytes())], pa.binary())],
                                          names=["block", "i", "l", "lens", "texts"])

    for rows, data, offs in text_chunks(batches, "t"):
        held.append((rows.select(["i", "l"]), data, offs))
        size += len(data)
        if size >= BLOCK_BYTES:
            yield emit()
            held, size, seq = [], 0, seq + 1
    if held:
        yield emit()


def _opened(lens: bytes, texts: bytes):
    """The n-grams of a block's texts, hashed about a megabyte at a time."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum(unpack(lens))]).astype(np.int64)
    parts, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + (1 << 20), "right")) - 1)
        parts.append(_grams(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]))
        i = j
    return [np.concatenate(x) for x in zip(*parts)]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _asked(grams, slots: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-grams that the filter lets through, ascending, and
    where each shard's begin."""
    w, _, two, _, three = grams
    keys = _distinct(np.concatenate([w, two, three, [_B1, _B2]]))  # every context is one of these
    slot = keys >> np.uint64(64 - FILTER_BITS)
    keys = keys[(slots[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 > 0]
    return keys, np.searchsorted(_shard_of(keys, bits), np.arange((1 << bits) + 1))


def _ask(slots, bits: int):
    def run(batches):
        for batch in batches:
            for block, lens, texts in zip(*(batch.column(c).to_pylist() for c in ("block", "lens", "texts"))):
                *grams, _ = _opened(lens, texts)
                keys, cut = _asked(grams, slots.value, bits)
                full = np.flatnonzero(np.diff(cut)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([pack_sorted(keys[cut[s]:cut[s + 1]] >> SENT) for s in full], pa.binary())],
                                                 names=["shard", "block", "keys"])

    return run


_ANSWER = f"block long, shard int, {_PACKED}"


def _answer(model: pa.Table, asked: pa.Table) -> pa.Table:
    """One shard against the n-grams of some blocks: which of them it has (a
    bit each, as ``keys``), and their statistics."""
    rows = []
    if model.num_rows and asked.num_rows:
        keys, stats = unpack_sorted(model["keys"][0].as_py()) >> SENT, [unpack(model[c][0].as_py()) for c in STATS]
        for block, shard, q in zip(*(asked[c].to_pylist() for c in ("block", "shard", "keys"))):
            q = unpack_sorted(q)
            j = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            hit = keys[j] == q
            rows.append((block, shard, np.packbits(hit).tobytes(), *(pack(x[j[hit]]) for x in stats)))
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), *[pa.binary()] * (1 + len(STATS))))], names=["block", "shard", "keys", *STATS])


def _score(constants: tuple, slots, bits: int):
    schema = pa.schema([("i", pa.int64()), ("l", pa.string()), ("n", pa.int64()), ("s", pa.float64())])

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return schema.empty_table()
        *grams, per = _opened(blocks["lens"][0].as_py(), blocks["texts"][0].as_py())
        keys, cut = _asked(grams, slots.value, bits)
        got = {r["shard"]: r for r in answers.to_pylist()}
        hit, stats = [np.zeros(0, bool)], [[np.zeros(0, np.int32)] for _ in STATS]
        for s in range(1 << bits):
            n = int(cut[s + 1] - cut[s])
            if n and s in got:
                hit.append(np.unpackbits(np.frombuffer(got[s]["keys"], np.uint8), count=n).astype(bool))
                for k, c in enumerate(STATS):
                    stats[k].append(unpack(got[s][c]))
            else:
                hit.append(np.zeros(n, bool))
        found = Found(keys[np.concatenate(hit)], [np.concatenate(x) for x in stats], constants)
        total = np.concatenate([[0.0], np.cumsum(found.logp(*grams))])
        at = np.concatenate([[0], np.cumsum(per)])
        return pa.Table.from_arrays([pa.array(blocks["i"][0].as_py(), pa.int64()), pa.array(blocks["l"][0].as_py(), pa.string()), pa.array(per, pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.float64())], schema=schema)

    return run


def score(text: DataFrame, model: Model) -> DataFrame:
    """``i, l, n, s``: words and summed log10 probability of every text ``t``.

    Blocks of documents ask the shards for the n-grams that the filter does not
    exclude; a shard's requests are dealt to as many tasks as there are blocks
    for, each with its copy of the shard.  The texts stay where they are stored."""
    slots = text.sparkSession.sparkContext.broadcast(model.slots)  # a fixed number of bits
    blocks = stored_by(text.mapInArrow(_blocks, "block long, i array<long>, l array<string>, lens binary, texts binary"), "block", shards(text.sparkSession), "blocks")
    deals = -(-blocks.count() // (ASKED_BLOCKS << (model.bits - SHARD_BITS))) or 1
    asked = blocks.select("block", "lens", "texts").mapInArrow(_ask(slots, model.bits), "shard int, block long, keys binary")
    asked = asked.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(deals)))
    copies = model.table.select("shard", "keys", *STATS).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)).cast("array<long>")))
    answers = copies.groupBy("shard", "deal").cogroup(asked.groupBy("shard", "deal")).applyInArrow(_answer, _ANSWER)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(model.constants, slots, model.bits), "i long, l string, n long, s double")


def quality_scores(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   quantile: float = QUANTILE, margin: float = MARGIN, prior: float = PRIOR, least: int = LEAST) -> DataFrame:
    """``doc_id, lang, n_words, log10_prob, perplexity, threshold, accepted``
    per input row; ``trusted`` has the ids of trusted documents in its first column."""
    text = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("l"), F.col(text_col).cast("string").alias("t"))
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("i")).where("i is not null").distinct()
    sizes = text.select("i", F.octet_length("t").alias("b")).join(ids, "i", "left_semi").agg(F.sum("b")).first()[0] or 0
    bits = min(MOST_BITS, max(SHARD_BITS, (-(-sizes // 2 // SHARD_BYTES)).bit_length()))
    chosen = F.pmod(F.xxhash64(F.col("i"), F.lit(7)), F.lit(1 << 20)) < F.lit(1 << 19)
    fits = ids.where(chosen)
    few = F.broadcast(fits) if fits.count() <= BROADCAST_IDS else fits
    model = fit(text.select("i", "t").where(chosen).join(few, "i", "left_semi"), bits)
    if model is None:
        words = F.size(F.filter(F.split(F.coalesce("t", F.lit("")), r"[ \t-\r]+"), lambda x: x != ""))
        return text.select(F.col("i").alias("doc_id"), F.col("l").alias("lang"), words.cast("long").alias("n_words"), F.lit(None).cast("double").alias("log10_prob"),
                           F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (words > 0).alias("accepted"))
    scored = stored(score(text, model), "scores")
    calm = stored(scored.where("n > 0").join(ids.where(~chosen), "i", "left_semi"), "calibration")
    mu = calm.groupBy("l").agg((F.sum("s") / F.sum("n")).alias("mu"), F.count("*").alias("k"))
    all_mu = calm.agg((F.sum("s") / F.sum("n")).alias("amu"))
    mean = lambda df: (df.join(F.broadcast(mu), "l", "left").crossJoin(F.broadcast(all_mu))  # noqa: E731  a row per language, and one
                       .withColumn("mu", F.coalesce(F.when(F.col("k") >= least, F.col("mu")), F.col("amu"), F.lit(0.0)))
                       .withColumn("x", -(F.col("s") + prior * F.col("mu")) / (F.col("n") + prior)))
    cuts = mean(calm)
    by = cuts.groupBy("l").agg(F.percentile_approx("x", F.lit(quantile), F.lit(100_000)).alias("cut"), F.count("*").alias("kk"))
    every = cuts.agg(F.percentile_approx("x", F.lit(quantile), F.lit(100_000)).alias("acut"))
    out = mean(scored).join(F.broadcast(by), "l", "left").crossJoin(F.broadcast(every))
    limit = F.coalesce(F.when(F.col("kk") >= least, F.col("cut")), F.col("acut"), F.lit(300.0)) + margin
    has = F.col("n") > 0
    return out.select(F.col("i").alias("doc_id"), F.col("l").alias("lang"), F.col("n").alias("n_words"), F.when(has, F.col("s")).alias("log10_prob"),
                      F.when(has, F.pow(F.lit(10.0), "x")).alias("perplexity"), F.pow(F.lit(10.0), limit).alias("threshold"), (has & (F.col("x") <= limit)).alias("accepted"))
