"""Token tables: vocabulary, counts, word frequency, noise schedule, corruption.

Tokens are kept in long form ``(row_id, pos, token_id)`` where a statistic
is a grouping or a join, and as one ``ARRAY<INT>`` per row where the
reference works on fixed-width rows.  A single document's tokens are bounded
by the document, so per-row arrays never gather more than one text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from helixframe.functions.tokens import (CLS_ID, CONTINUATION_PREFIX, MASK_ID, MAX_LENGTH, N_SPECIAL, PAD_ID,
                                         SEP_ID, SPECIAL_TOKENS, add_special, attention_mask, pad_right,
                                         split_words, truncate_tokens, uniform_draw)
from helixframe.operators.ranking import global_row_number
from helixframe.session import stored

BLOCK_VALUES = 1_000_000      # values of whole rows that are looked up together

# --- fixed values (published defaults) ---
DEFAULT_STEPS = 2000          # sampling steps
WORD_FREQ_LAMBDA = 0.3        # frequency weight, modulated by sin(pi t / T)
KEEP_PROB_CAP = 0.999
COSINE_S = 0.008
LINEAR_BETA_MIN = 1e-3
LINEAR_BETA_MAX = 1e-1
TOP_K = 10
# --- end of fixed values ---


# ----------------------------------------------------------------- words
def words_long(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row_id, pos, word)`` for every whitespace word of every whole text."""
    return docs.select(F.col(id_col).alias("row_id"), F.posexplode(split_words(text_col)).alias("pos", "word"))


def build_vocabulary(words: DataFrame) -> DataFrame:
    """Distinct words ranked by count desc, then word; ids start after the specials.

    ``(word, n, token_id, is_continuation)``.  The ranking is a range-partitioned
    global row number, not a single-partition window.
    """
    return rank_words(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def rank_words(counts: DataFrame) -> DataFrame:
    """The vocabulary from ``(word, n)``."""
    ranked = global_row_number(counts, [F.col("n").desc(), F.col("word").asc()], "rn")
    return ranked.select("word", "n", (F.col("rn") + N_SPECIAL - 1).cast("int").alias("token_id"),
                         F.col("word").startswith(CONTINUATION_PREFIX).alias("is_continuation"))


def special_vocabulary(spark: SparkSession) -> DataFrame:
    rows = [(w, 0, i, False) for i, w in enumerate(SPECIAL_TOKENS)]
    return spark.createDataFrame(rows, "word string, n long, token_id int, is_continuation boolean")


def full_vocabulary(words: DataFrame) -> DataFrame:
    """Specials plus corpus words: the id spine for zero-filled statistics."""
    return special_vocabulary(words.sparkSession).unionByName(build_vocabulary(words))


# ---------------------------------------------------------------- blocks
def value_blocks(arrays: DataFrame, key: str, values: str) -> DataFrame:
    """Rows of arrays as stored blocks of whole rows, about ``BLOCK_VALUES``
    values each: the rows' ``key``s and lengths, the block's distinct values with
    their counts, and a code per value.  Rows without values are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in arrays.select(key, values).schema}

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def emit():
            ids = pa.concat_arrays([b.column(0) for b in held])
            flat = pa.concat_arrays([b.column(1).flatten() for b in held]).dictionary_encode(null_encoding="encode")
            codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            lens = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in held]).astype(np.int32)
            counts = pa.array([np.bincount(codes, minlength=len(flat.dictionary)).astype(np.int64)], pa.list_(pa.int64()))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, flat.dictionary)]
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (lens, codes)]
            return pa.RecordBatch.from_arrays([pa.array([(part << 33) + seq], pa.int64()), *lists, counts, *packed], names=["block", "ids", "values", "counts", "lens", "codes"])

        for batch in batches:
            offs, i = batch.column(1).offsets.to_numpy(), 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK_VALUES - n, "right")) - 1)
                held.append(batch.slice(i, j - i))
                n, i = n + int(offs[j] - offs[i]), j
                if n >= BLOCK_VALUES:
                    yield emit()
                    held, n, seq = [], 0, seq + 1
        if held:
            yield emit()

    schema = f"block long, ids array<{kinds[key]}>, values {kinds[values]}, counts array<long>, lens binary, codes binary"
    return stored(arrays.where(F.size(values) > 0).select(key, values).mapInArrow(run, schema), "blocks", wide=True)


def block_counts(blocks: DataFrame, value: str = "word") -> DataFrame:
    """``(value, n)`` of all distinct values, from their counts by block."""
    each = blocks.select(F.inline(F.arrays_zip(F.col("values").alias(value), F.col("counts").alias("n"))))
    return each.groupBy(value).agg(F.sum("n").alias("n"))


def look_up(blocks: DataFrame, table: DataFrame, value: str, columns: list[str], key: str = "row_id") -> DataFrame:
    """``key`` and, for each of ``columns``, the array of what ``table`` has for
    the row's values (null where it has none).

    Blocks ask for their distinct values by an equi-join on ``value``, whose
    rows are unique in ``table``, and put the answers into place: no row per
    value is exchanged, and neither a broadcast nor an in-memory hash build of
    the table, which grows with the corpus, is forced."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    ids = blocks.schema["ids"].dataType.simpleString()[len("array<"):-1]

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.schema([(key, block.schema.field("ids").type.value_type), *((c, pa.list_(found.schema.field(c).type)) for c in columns)]).empty_table()
        lens, codes = (np.frombuffer(block[c][0].as_py(), np.int32) for c in ("lens", "codes"))
        at = _places(found, len(block["values"][0]))
        offs = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
        out = {key: block["ids"].combine_chunks().flatten()}
        for c in columns:
            out[c] = pa.ListArray.from_arrays(offs, found[c].combine_chunks().take(at).take(pa.array(codes)))
        return pa.table(out)

    schema = ", ".join([f"{key} {ids}", *(f"{c} array<{kinds[c]}>" for c in columns)])
    return blocks.drop("counts").groupBy("block").cogroup(_answers(blocks, table, value, columns).groupBy("asker")).applyInArrow(run, schema)


def _answers(blocks: DataFrame, table: DataFrame, value: str, columns: list[str]) -> DataFrame:
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("values").alias("i", value))
    return asked.join(table.select(value, *columns), value).select("asker", "i", *columns)


def _places(found: pa.Table, n: int) -> pa.Array:
    """Where the answers to a block's ``n`` distinct values are; null: nowhere."""
    place = np.full(n, -1)
    place[found["i"].to_numpy()] = np.arange(found.num_rows)
    return pa.array(place, mask=place < 0)


def encode_blocks(blocks: DataFrame, vocab: DataFrame) -> DataFrame:
    """Word -> id on blocks: stored blocks of the same rows whose values are
    ids, one for each distinct word."""
    ids = blocks.schema["ids"].dataType.simpleString()

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        at = _places(found, len(block["values"][0]))
        values = found["token_id"].combine_chunks().take(at)
        return block.set_column(block.schema.get_field_index("values"), "values", pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))

    answers = _answers(blocks, vocab, "word", ["token_id"])
    return stored(blocks.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(run, f"block long, ids {ids}, values array<int>, counts array<long>, lens binary, codes binary"), "encoded", wide=True)


def encode_arrays(blocks: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Word -> id: ``row_id, token_id`` as one array a row, in order, and
    arrays of further columns of ``vocab``."""
    return look_up(blocks, vocab, "word", ["token_id", *keep])


def holds_arrays(df: DataFrame, column: str) -> bool:
    """Whether a token column is one array a row, not one value a row."""
    return isinstance(df.schema[column].dataType, ArrayType)


def arrays_long(arrays: DataFrame, columns: list[str], key: str = "row_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key, pos, column ..., carry ...)`` of arrays of equal lengths and the
    rows' other columns ``carry``."""
    first, *more = columns
    long = arrays.select("*", F.posexplode(first).alias("pos", "__v"))
    return long.select(key, "pos", F.col("__v").alias(first), *[F.get(c, F.col("pos")).alias(c) for c in more], *carry)


def merge_ordered(arrays: DataFrame, key: str, values: str, name: str) -> DataFrame:
    """One array per key; rows that share a key are merged by position, then value."""
    numbered = F.transform("__parts", lambda p: F.transform(p, lambda v, i: F.struct(i.alias("p"), v.alias("v"))))
    merged = F.transform(F.array_sort(F.flatten(numbered)), lambda s: s["v"])
    parts = arrays.groupBy(key).agg(F.collect_list(values).alias("__parts"))
    return parts.select(key, F.when(F.size("__parts") == 1, F.col("__parts")[0]).otherwise(merged).alias(name))


# ------------------------------------------------------------ statistics
def token_counts(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """A1: occurrences per vocabulary id, 0 for unseen ids."""
    counts = tokens.groupBy("token_id").agg(F.count(F.lit(1)).alias("n_obs"))
    return (vocab.select("token_id").join(counts, "token_id", "left")
                 .select("token_id", F.coalesce("n_obs", F.lit(0)).cast("long").alias("n")))


def word_freq(counts: DataFrame, special_ids: tuple[int, ...] = (PAD_ID, SEP_ID, CLS_ID),
              keep: tuple[str, ...] = ()) -> DataFrame:
    """A2: ln(n+1) / max ln(n+1); specials zeroed after normalising (so they
    take part in the maximum).  The maximum is a one-row aggregate.  ``keep``
    names further columns of ``counts`` to carry along."""
    top = counts.agg(F.max(F.log1p("n")).alias("__mx"))
    return (counts.crossJoin(F.broadcast(top))
                  .select("token_id", *keep,
                          F.when(F.col("token_id").isin(*special_ids), F.lit(0.0))
                          .otherwise(F.log1p("n") / F.col("__mx")).alias("wf")))


def token_freq_lookup(tokens: DataFrame, wf: DataFrame) -> DataFrame:
    """Every token replaced by its normalised corpus frequency."""
    return tokens.join(wf, "token_id").select("row_id", "pos", "token_id", "wf")


def centred_word_freq(tokens_wf: DataFrame) -> DataFrame:
    """A3: wf minus its mean over the same sequence.

    The mean is a window over the sequence, so the tokens are shuffled once;
    a window by position over the same sequences (W11) shares that exchange.
    Where ``wf`` is an array, so is the result: rows are summed by themselves,
    and the window meets one row per array, never one per token."""
    by_row = Window.partitionBy("row_id")
    if not holds_arrays(tokens_wf, "wf"):
        return tokens_wf.withColumn("wf_centred", F.col("wf") - F.avg("wf").over(by_row))
    known = F.filter("wf", lambda x: x.isNotNull())
    summed = tokens_wf.withColumn("__sum", F.aggregate(known, F.lit(0.0), lambda a, x: a + x)).withColumn("__n", F.size(known))
    mean = F.try_divide(F.sum("__sum").over(by_row), F.sum("__n").over(by_row))
    centred = summed.withColumn("__mean", mean)
    return centred.withColumn("wf_centred", F.transform("wf", lambda x: x - F.col("__mean"))).drop("__sum", "__n", "__mean")


# -------------------------------------------------------------- schedules
def beta(kind: str, t: Column, steps: int, beta_min: float = LINEAR_BETA_MIN,
         beta_max: float = LINEAR_BETA_MAX, s: float = COSINE_S) -> Column:
    """beta at step t (0-based).

    ``mutual``: 1/(T-t).  ``cosine``: clip(1 - f(t+1)/f(t), 0, .999) with
    f(x) = cos((x/T + s)/(1+s) * pi/2).  ``linear`` (ours; the reference's
    helper is missing): beta_min + (beta_max - beta_min) * t / T.
    """
    tt = t.cast("double")
    if kind == "mutual":
        return F.lit(1.0) / (F.lit(float(steps)) - tt)
    if kind == "cosine":
        def f(x: Column) -> Column:
            return F.cos((x / steps + s) / (1 + s) * (math.pi / 2))
        return F.least(F.greatest(F.lit(1.0) - f(tt + 1) / f(tt), F.lit(0.0)), F.lit(0.999))
    if kind == "linear":
        return F.lit(beta_min) + F.lit(beta_max - beta_min) * tt / steps
    raise ValueError(kind)


def survival_schedule(spark: SparkSession, steps: int = DEFAULT_STEPS, kind: str = "mutual") -> DataFrame:
    """``(t, beta, survival)`` for t = 0..T.

    survival_0 = 1, survival_t = prod_{s<t} (1 - beta_s), survival_T forced
    to 0 before any logarithm is taken.  The table has T+1 rows (a parameter,
    not data), so the running product may use one ordered window.
    """
    base = spark.range(0, steps + 1).select(F.col("id").cast("int").alias("t"))
    b = base.withColumn("beta", F.when(F.col("t") < steps, beta(kind, F.col("t"), steps)))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    log_keep = F.sum(F.log(F.greatest(F.lit(1.0) - F.col("beta"), F.lit(1e-300)))).over(w)
    return b.select("t", "beta",
                    F.when(F.col("t") == 0, F.lit(1.0))
                    .when(F.col("t") == steps, F.lit(0.0))
                    .otherwise(F.exp(log_keep)).alias("survival"))


def keep_probability(survival: Column, wf_centred: Column, t: Column, steps: int,
                     lam: float = WORD_FREQ_LAMBDA) -> Column:
    """F16: clip(S_t + wf_centred * lambda * sin(pi t / T), 0, .999); at t = 0
    every token stays."""
    mod = F.lit(lam) * F.sin(t.cast("double") / steps * math.pi)
    clipped = F.least(F.greatest(survival + wf_centred * mod, F.lit(0.0)), F.lit(KEEP_PROB_CAP))
    return F.when(t == 0, F.lit(1.0)).otherwise(clipped)


def corrupt(tokens: DataFrame, seed: int, keep_prob: str = "keep_prob", t: str = "t",
            mask_id: int = MASK_ID) -> DataFrame:
    """replace a token by the mask id unless a reproducible draw survives.
    Arrays of tokens and probabilities give an array ``noised``."""
    if holds_arrays(tokens, keep_prob):
        both = F.zip_with("token_id", keep_prob, lambda x, p: F.struct(x.alias("x"), p.alias("p")))  # each made once a row
        return tokens.withColumn("noised", F.transform(both, lambda v, i: F.when(
            uniform_draw(F.lit(seed), F.col("row_id"), i, F.col(t)) < v["p"], v["x"]).otherwise(F.lit(mask_id))))
    u = uniform_draw(F.lit(seed), F.col("row_id"), F.col("pos"), F.col(t))
    return tokens.withColumn("u", u).withColumn(
        "noised", F.when(F.col("u") < F.col(keep_prob), F.col("token_id")).otherwise(F.lit(mask_id)))


def whole_word_mask(tokens: DataFrame, is_continuation: str = "is_continuation", masked: str = "masked",
                    name: str = "ww_masked") -> DataFrame:
    """A continuation piece is masked exactly when its word head is.

    One ordered window per row: every piece takes the mask state of the
    latest word head at or before it; continuation pieces before the first
    head follow the row's first piece.  (Same result as numbering the words
    and taking the first state per word, with a single sort.)

    Rows of arrays (states are not null) become tokens: an array alone under
    its ``row_id`` is followed by itself, without a sort or a window of its
    tokens; those that share one meet token by token as above.
    """
    if holds_arrays(tokens, masked):
        arrays = [f.name for f in tokens.schema if isinstance(f.dataType, ArrayType)]
        carry = tuple(c for c in tokens.columns if c not in {"row_id", *arrays})
        counted = tokens.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy("row_id")))
        alone = counted.where("__rows = 1").withColumn(name, _follow_heads(masked, is_continuation))
        shared = arrays_long(counted.where("__rows > 1"), arrays, carry=carry)
        return arrays_long(alone, [*arrays, name], carry=carry).unionByName(whole_word_mask(shared, is_continuation, masked, name))
    w = Window.partitionBy("row_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head_state = F.last(F.when(~F.col(is_continuation), F.col(masked)), ignorenulls=True).over(w)
    return tokens.withColumn(name, F.coalesce(head_state, F.first(masked).over(w)))


@F.arrow_udf(ArrayType(BooleanType()))
def _follow_heads(masked: pa.Array, is_continuation: pa.Array) -> pa.Array:
    """Of each array, the state of the latest word head at or before a piece;
    before the first head, that of the first piece."""
    lens = np.diff(masked.offsets.to_numpy())
    state = masked.flatten().to_numpy(zero_copy_only=False)
    follows = is_continuation.flatten().fill_null(True).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lens)])
    head = np.maximum.accumulate(np.where(follows, np.repeat(starts[:-1], lens), np.arange(len(state))))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(state[head], pa.bool_()))


# ----------------------------------------------------------- fixed width
def encode_fixed(tokens: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """F8 on id arrays: truncate (O4), add specials (P8), pad to the table's
    width (A34: min(max_length, longest row)) and build the attention mask."""
    t = tokens.withColumn("ids", add_special(truncate_tokens("tokens", max_length)))
    width = t.agg(F.least(F.lit(max_length), F.max(F.size("ids"))).alias("width"))
    return (t.crossJoin(F.broadcast(width))
             .select("row_id", pad_right("ids", F.col("width"), PAD_ID).alias("input_ids"),
                     attention_mask("ids", F.col("width")).alias("attention_mask"), "width"))


# ------------------------------------------------------------ candidates
def topk_filter(logits: Column, k: int = TOP_K) -> Column:
    """W9 in-row: values below the k-th best become -inf (ties at k kept)."""
    from helixframe.functions.numeric import let
    return let(F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits))), lambda kth:
               F.transform(logits, lambda x: F.when(x >= kth, x).otherwise(F.lit(float("-inf")))))


def nucleus_filter(logits: Column, p: float) -> Column:
    """W10 in-row: keep the smallest top set whose softmax mass reaches p
    (at least one); others become -inf.  Ties at the threshold are kept.

    The running mass is one ``aggregate`` pass over the sorted probabilities
    (O(n log n) per row), and every intermediate array is bound once.
    """
    from helixframe.functions.numeric import let, softmax
    init = F.struct(F.lit(0.0).alias("mass"), F.lit(None).cast("double").alias("thr"))
    return let(softmax(logits), lambda probs:
               let(F.aggregate(F.sort_array(probs, asc=False), init,
                               lambda acc, x: F.struct(
                                   (acc["mass"] + x).alias("mass"),
                                   F.when((acc["mass"] < p) | acc["thr"].isNull(), x)
                                   .otherwise(acc["thr"]).alias("thr"))),
                   lambda st: F.zip_with(logits, probs, lambda z, q: F.when(q >= st["thr"], z)
                                         .otherwise(F.lit(float("-inf"))))))


# ---------------------------------------------------------- strategies
def corrupt_with(tokens: DataFrame, strategy: str, seed: int, mask_id: int = MASK_ID) -> DataFrame:
    """Pluggable corruption.  ``independent`` masks tokens one by one
    (F17); ``whole_word`` then lets every continuation piece follow its word
    head (W11).  Needs ``row_id, pos, token_id, t, keep_prob`` and, for
    whole words, ``is_continuation``; or, for whole words, rows of arrays
    without ``pos``, which become tokens."""
    noised = corrupt(tokens, seed, mask_id=mask_id)
    if strategy == "independent":
        return noised
    if strategy == "whole_word":
        masked = F.transform("noised", lambda x: x == mask_id) if holds_arrays(noised, "noised") else F.col("noised") == mask_id
        ww = whole_word_mask(noised.withColumn("masked", masked))
        return ww.withColumn("noised", F.when(F.col("ww_masked"), F.lit(mask_id)).otherwise(F.col("token_id")))
    raise ValueError(strategy)


def masked_restore(selected: DataFrame, rows: DataFrame, value: str = "token_id", out: str = "ids") -> DataFrame:
    """P9, the way back: ``(row_id, pos, value)`` of the selected positions to
    one array of the row's ``width`` per row of ``rows``, zero where nothing
    was selected.  One shuffle of the selected values; a row's array is filled
    in place, no spine of positions is joined."""
    got = selected.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", value))).alias("__m"))
    filled = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0)))
    none = F.array_repeat(F.lit(0), F.col("width"))
    return rows.join(got, "row_id", "left").select("row_id", F.when(F.col("width") <= 0, F.array().cast("array<int>")).when(F.col("__m").isNull(), none).otherwise(filled).alias(out))
