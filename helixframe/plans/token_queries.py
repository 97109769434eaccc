"""Token operators (2.4 A1-A3, A24, A34; 2.5 W7, W9-W11; 2.8 F3, F4, F8,
F15-F18; 2.2 P7-P9; 2.6 O4; 2.3 J4) bound to ``documents`` and ``embeddings``.

Tokens are the whitespace words of the whole text; the vocabulary is every
distinct word ranked by count (desc) then word, after five special ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import tokens as TF
from helixframe.functions.numeric import one_hot
from helixframe.operators import tokens as T
from helixframe.plans.registry import finish, register
from helixframe.sources.tables import table

# --- fixed values of the bindings ---
SEED = 42
STEPS = T.DEFAULT_STEPS
NUCLEUS_P = 0.9
# --- end of fixed values ---

_SPECIAL_ROWS = ", ".join(f"('{w}', 0, {i}, false)" for i, w in enumerate(TF.SPECIAL_TOKENS))

SQL_TOKENS = rf"""
words AS (
  SELECT row_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS word
  FROM (SELECT doc_id AS row_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w
        FROM documents)),
vocab AS (
  SELECT word, n, CAST({TF.N_SPECIAL - 1} + row_number() OVER (ORDER BY n DESC, word ASC) AS INTEGER) AS token_id,
         starts_with(word, '##') AS is_continuation
  FROM (SELECT word, count(*) AS n FROM words GROUP BY word)),
specials AS (SELECT * FROM (VALUES {_SPECIAL_ROWS}) AS t(word, n, token_id, is_continuation)),
fullvocab AS (SELECT word, CAST(n AS BIGINT) AS n, CAST(token_id AS INTEGER) AS token_id, is_continuation
              FROM specials UNION ALL SELECT * FROM vocab),
toks AS (SELECT w.row_id, w.pos, v.token_id FROM words w JOIN vocab v USING (word)),
tokarr AS (SELECT row_id, list(token_id ORDER BY pos) AS tokens FROM toks GROUP BY row_id),
counts AS (SELECT fv.token_id, CAST(COALESCE(c.n_obs, 0) AS BIGINT) AS n
           FROM fullvocab fv LEFT JOIN (SELECT token_id, count(*) AS n_obs FROM toks GROUP BY token_id) c
           USING (token_id)),
wf AS (SELECT token_id,
              CASE WHEN token_id IN ({TF.PAD_ID}, {TF.SEP_ID}, {TF.CLS_ID}) THEN CAST(0.0 AS DOUBLE)
                   ELSE ln(1 + n) / (SELECT max(ln(1 + n)) FROM counts) END AS wf
       FROM counts),
twf AS (SELECT toks.row_id, toks.pos, toks.token_id, wf.wf FROM toks JOIN wf USING (token_id)),
centred AS (SELECT *, wf - avg(wf) OVER (PARTITION BY row_id) AS wf_centred FROM twf)
"""


def _md5_u(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT) / 4294967296.0"


def _md5_k(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


# ------------------------------------------------------------------ spark
def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return T.words_long(_docs(spark, d))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The documents' words as stored blocks: texts are split once."""
    words = _docs(spark, d).select(F.col("doc_id").alias("row_id"), TF.split_words("text").alias("words"))
    return T.value_blocks(words, "row_id", "words")


def _vocab_and_tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = _blocks(spark, d)
    vocab = T.rank_words(T.block_counts(blocks))
    return vocab, T.encode_arrays(blocks, vocab)


def _token_arrays(spark: SparkSession, d: str) -> DataFrame:
    return T.merge_ordered(_vocab_and_tokens(spark, d)[1], "row_id", "token_id", "tokens")


def _truncated_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Token arrays cut to the length O4 keeps.  The vocabulary counts all
    words of the whole texts; ids that O4 drops are dropped before the exchange."""
    toks = _vocab_and_tokens(spark, d)[1].withColumn("token_id", TF.truncate_tokens("token_id"))
    return T.merge_ordered(toks, "row_id", "token_id", "tokens")


def _wf(spark: SparkSession, vocab: DataFrame) -> DataFrame:
    """A2.  Every word maps to exactly one id, so the token counts A1 would
    produce are the vocabulary's own word counts."""
    return T.word_freq(T.special_vocabulary(spark).unionByName(vocab).select("token_id", "n"))


_TOKEN_COLUMNS = ["token_id", "wf", "word_continues"]


def _wf_arrays(spark: SparkSession, d: str) -> DataFrame:
    """``row_id`` and arrays of ``token_id, wf, word_continues`` with one lookup: the
    frequency is a projection of the vocabulary's own counts, and whether a
    word continues the previous one (it does not start with a capital) is one
    of the word."""
    blocks = _blocks(spark, d)
    full = T.special_vocabulary(spark).unionByName(T.rank_words(T.block_counts(blocks)))
    lookup = T.word_freq(full, keep=("word",)).where(F.col("token_id") >= T.N_SPECIAL) \
        .withColumn("word_continues", ~F.col("word").rlike("^[A-Z]"))
    return T.look_up(blocks, lookup, "word", _TOKEN_COLUMNS)


def _doc_step(row_id: F.Column) -> F.Column:
    return (TF.hash_key(F.lit(SEED), row_id) % (STEPS + 1)).cast("int")


_SQL_STEP = "CAST(" + _md5_k(f"concat_ws(':', {SEED}, doc_id)") + f" % {STEPS + 1} AS INTEGER)"


@register("split_words", sql=f"WITH {SQL_TOKENS} "
          "SELECT doc_id AS row_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words "
          "FROM documents")
def q_split_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("doc_id").alias("row_id"), TF.split_words("text").alias("words"))


@register("token_counts", sql=f"WITH {SQL_TOKENS} SELECT * FROM counts")
def q_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """A1: the vocabulary counts its words when it is built; specials have 0."""
    return T.full_vocabulary(_words(spark, d)).select("token_id", "n")


@register("word_freq", sql=f"WITH {SQL_TOKENS} SELECT * FROM wf")
def q_word_freq(spark: SparkSession, d: str) -> DataFrame:
    return finish(_wf(spark, T.build_vocabulary(_words(spark, d))))


@register("token_freq_lookup", sql=f"WITH {SQL_TOKENS} SELECT * FROM twf")
def q_token_freq_lookup(spark: SparkSession, d: str) -> DataFrame:
    vocab, toks = _vocab_and_tokens(spark, d)
    return finish(T.token_freq_lookup(T.arrays_long(toks, ["token_id"]), _wf(spark, vocab)))


@register("centred_word_freq", sql=f"WITH {SQL_TOKENS} SELECT row_id, pos, token_id, wf_centred FROM centred")
def q_centred_word_freq(spark: SparkSession, d: str) -> DataFrame:
    c = T.centred_word_freq(_wf_arrays(spark, d))
    return finish(T.arrays_long(c, ["token_id", "wf_centred"]))


_SQL_ENC = f"""
enc0 AS (SELECT row_id, list_concat([{TF.CLS_ID}], tokens[1:{TF.MAX_LENGTH - 2}], [{TF.SEP_ID}]) AS ids FROM tokarr),
enc AS (SELECT row_id,
               list_concat(ids, list_transform(range(greatest(w - len(ids), 0)), lambda x: {TF.PAD_ID})) AS input_ids,
               list_concat(list_transform(range(len(ids)), lambda x: 1),
                           list_transform(range(greatest(w - len(ids), 0)), lambda x: 0)) AS attention_mask,
               CAST(w AS INTEGER) AS width
        FROM enc0, (SELECT least({TF.MAX_LENGTH}, max(len(ids))) AS w FROM enc0))
"""


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return T.encode_fixed(_truncated_arrays(spark, d))


@register("encode_tokens", sql=f"WITH {SQL_TOKENS}, {_SQL_ENC} SELECT * FROM enc")
def q_encode_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d)


@register("truncate_tokens", sql=f"WITH {SQL_TOKENS} SELECT row_id, tokens[1:{TF.MAX_LENGTH - 2}] AS tokens "
                                 "FROM tokarr")
def q_truncate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _truncated_arrays(spark, d).select("row_id", TF.truncate_tokens("tokens").alias("tokens"))


@register("add_special", sql=f"WITH {SQL_TOKENS} SELECT row_id, "
          f"list_concat([{TF.CLS_ID}], tokens[1:{TF.MAX_LENGTH - 2}], [{TF.SEP_ID}]) AS ids, "
          "list_concat([1], list_transform(tokens[1:98], lambda x: 1), [0]) AS mask FROM tokarr")
def q_add_special(spark: SparkSession, d: str) -> DataFrame:
    t = _truncated_arrays(spark, d).select("row_id", TF.truncate_tokens("tokens").alias("t"))
    return t.select("row_id", TF.add_special("t").alias("ids"),
                    TF.add_special_mask(F.transform("t", lambda x: F.lit(1))).alias("mask"))


@register("trim_special", sql=f"WITH {SQL_TOKENS}, {_SQL_ENC} SELECT row_id, "
          "input_ids[2:greatest(len(input_ids) - 1, 1)] AS tokens, "
          "attention_mask[2:greatest(len(attention_mask) - 1, 1)] AS mask FROM enc")
def q_trim_special(spark: SparkSession, d: str) -> DataFrame:
    e = _encoded(spark, d)
    return e.select("row_id", TF.trim_special("input_ids").alias("tokens"),
                    TF.trim_special("attention_mask").alias("mask"))


@register("masked_select", sql=f"WITH {SQL_TOKENS}, {_SQL_ENC} "
          "SELECT row_id, pos, token_id FROM ("
          "  SELECT row_id, CAST(unnest(range(len(input_ids))) AS INTEGER) AS pos, unnest(input_ids) AS token_id, "
          "         unnest(attention_mask) AS m FROM enc) WHERE m = 1")
def q_masked_select(spark: SparkSession, d: str) -> DataFrame:
    """Keep only real (mask = 1) positions, remembering the position."""
    e = _encoded(spark, d)
    z = e.select("row_id", F.posexplode(F.arrays_zip("input_ids", "attention_mask")).alias("pos", "z"))
    return z.where(F.col("z.attention_mask") == 1).select("row_id", "pos",
                                                          F.col("z.input_ids").alias("token_id"))


@register("masked_restore", sql=f"WITH {SQL_TOKENS}, {_SQL_ENC} "
          "SELECT row_id, list_transform(list_zip(input_ids, attention_mask), lambda t: t[1] * t[2]) AS ids FROM enc")
def q_masked_restore(spark: SparkSession, d: str) -> DataFrame:
    """P9 back: the selected positions put into place, zeros elsewhere."""
    e = _encoded(spark, d)
    return T.masked_restore(q_masked_select(spark, d), e.select("row_id", "width"), "token_id", "ids")


@register("pad_width", sql=f"WITH {SQL_TOKENS}, {_SQL_ENC} SELECT DISTINCT width FROM enc")
def q_pad_width(spark: SparkSession, d: str) -> DataFrame:
    """min(100, longest token row) over the whole table."""
    words = F.size(TF.split_words("text"))
    return _docs(spark, d).agg(F.least(F.max(words) + 2, F.lit(TF.MAX_LENGTH)).alias("width"))


@register("decode_tokens", sql=f"WITH {SQL_TOKENS} "
          "SELECT row_id, sentence, replace(sentence, ' ', '') AS sequence FROM ("
          "  SELECT t.row_id, string_agg(fv.word, ' ' ORDER BY t.pos) AS sentence "
          "  FROM toks t JOIN fullvocab fv USING (token_id) GROUP BY t.row_id)")
def q_decode_tokens(spark: SparkSession, d: str) -> DataFrame:
    """ids back to words joined by a blank, then blanks removed."""
    blocks = _blocks(spark, d)
    vocab = T.rank_words(T.block_counts(blocks))
    full = T.special_vocabulary(spark).unionByName(vocab)
    dec = T.look_up(T.encode_blocks(blocks, vocab), full, "token_id", ["word"])
    arr = T.merge_ordered(dec, "row_id", "word", "w")
    sent = F.array_join("w", " ")
    return arr.select("row_id", sent.alias("sentence"), F.replace(sent, F.lit(" "), F.lit("")).alias("sequence"))


@register("distinct_tokens", sql=f"WITH {SQL_TOKENS} "
          "SELECT row_id, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_distinct FROM tokarr")
def q_distinct_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct token ids per sequence."""
    return _token_arrays(spark, d).select("row_id", F.size(F.array_distinct("tokens")).alias("n_distinct"))


@register("token_diversity", sql=f"WITH {SQL_TOKENS} "
          "SELECT avg(len(list_distinct(tokens)) / len(tokens)) AS diversity FROM tokarr")
def q_token_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Mean over sequences of distinct / length."""
    return finish(_token_arrays(spark, d).agg(F.avg(TF.token_diversity("tokens")).alias("diversity")))


# -------------------------------------------------------------- schedules
_SQL_SCHED = f"""
steps AS (SELECT CAST(range AS INTEGER) AS t FROM range(0, {STEPS + 1})),
b AS (SELECT t,
             CASE WHEN t < {STEPS} THEN 1.0 / (CAST({STEPS} AS DOUBLE) - t) END AS beta_mutual,
             CASE WHEN t < {STEPS} THEN least(greatest(1.0 - cos(((t + 1) / CAST({STEPS} AS DOUBLE) + {T.COSINE_S}) / (1 + {T.COSINE_S}) * (pi() / 2))
                                                 / cos((t / CAST({STEPS} AS DOUBLE) + {T.COSINE_S}) / (1 + {T.COSINE_S}) * (pi() / 2)), 0.0), 0.999) END
               AS beta_cosine,
             CASE WHEN t < {STEPS} THEN CAST('{T.LINEAR_BETA_MIN!r}' AS DOUBLE) + CAST('{T.LINEAR_BETA_MAX - T.LINEAR_BETA_MIN!r}' AS DOUBLE) * t / CAST({STEPS} AS DOUBLE) END
               AS beta_linear
      FROM steps),
sched AS (
  SELECT t, beta_mutual, beta_cosine, beta_linear,
         CASE WHEN t = 0 THEN 1.0 WHEN t = {STEPS} THEN 0.0 ELSE exp(sum(ln(greatest(1.0 - beta_mutual, 1e-300)))
              OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS survival_mutual,
         CASE WHEN t = 0 THEN 1.0 WHEN t = {STEPS} THEN 0.0 ELSE exp(sum(ln(greatest(1.0 - beta_cosine, 1e-300)))
              OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS survival_cosine
  FROM b),
docstep AS (SELECT doc_id AS row_id, {_SQL_STEP} AS t FROM documents)
"""


def _schedule(spark: SparkSession) -> DataFrame:
    m = T.survival_schedule(spark, STEPS, "mutual").withColumnRenamed("beta", "beta_mutual") \
        .withColumnRenamed("survival", "survival_mutual")
    c = T.survival_schedule(spark, STEPS, "cosine").withColumnRenamed("beta", "beta_cosine") \
        .withColumnRenamed("survival", "survival_cosine")
    lin = spark.range(0, STEPS + 1).select(F.col("id").cast("int").alias("t")).withColumn(
        "beta_linear", F.when(F.col("t") < STEPS, T.beta("linear", F.col("t"), STEPS)))
    # T+1 rows each: a parameter-sized table, broadcast by size.
    return m.join(c, "t").join(lin, "t")


def _doc_steps(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("doc_id").alias("row_id"), _doc_step(F.col("doc_id")).alias("t"))


@register("survival_schedule", sql=f"WITH {_SQL_SCHED} SELECT docstep.row_id, docstep.t, survival_mutual, "
          "survival_cosine FROM docstep JOIN sched USING (t)")
def q_survival_schedule(spark: SparkSession, d: str) -> DataFrame:
    """W7 at each document's diffusion step t = md5(seed, doc) mod (T+1)."""
    s = _schedule(spark)
    return finish(_doc_steps(spark, d).join(F.broadcast(s), "t")
                  .select("row_id", "t", "survival_mutual", "survival_cosine"))


@register("noise_schedule", sql=f"WITH {_SQL_SCHED} SELECT docstep.row_id, docstep.t, beta_mutual, beta_cosine, "
          "beta_linear FROM docstep JOIN sched USING (t)")
def q_noise_schedule(spark: SparkSession, d: str) -> DataFrame:
    """beta of the three schedule kinds at each document's step."""
    s = _schedule(spark)
    return finish(_doc_steps(spark, d).join(F.broadcast(s), "t")
                  .select("row_id", "t", "beta_mutual", "beta_cosine", "beta_linear"))


def _keep(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of tokens with centred wf and the probability to be kept, and the
    document's step t (a hash of the document id, computed once a document) with
    the survival at t (broadcast: T+1 rows)."""
    s = T.survival_schedule(spark, STEPS, "mutual").select("t", F.col("survival").alias("survival_mutual"))
    docs = _wf_arrays(spark, d).withColumn("t", _doc_step(F.col("row_id"))).join(F.broadcast(s), "t")
    c = T.centred_word_freq(docs)
    return c.select("row_id", "t", "token_id", "word_continues", F.transform("wf_centred", lambda x: T.keep_probability(
        F.col("survival_mutual"), x, F.col("t"), STEPS)).alias("keep_prob"))


_SQL_KEEP = f"""
kp AS (
  SELECT c.row_id, c.pos, c.token_id, ds.t,
         CASE WHEN ds.t = 0 THEN 1.0 ELSE
         least(greatest(s.survival_mutual + c.wf_centred * ({T.WORD_FREQ_LAMBDA} * sin(ds.t / CAST({STEPS} AS DOUBLE) * pi())), 0.0),
               {T.KEEP_PROB_CAP}) END AS keep_prob
  FROM centred c JOIN docstep ds USING (row_id) JOIN sched s ON s.t = ds.t),
noised AS (
  SELECT *, {_md5_u("concat_ws(':', " + str(SEED) + ", row_id, pos, t)")} AS u FROM kp),
noised2 AS (SELECT *, CASE WHEN u < keep_prob THEN token_id ELSE {TF.MASK_ID} END AS noised FROM noised)
"""


@register("freq_aware_keep_prob", sql=f"WITH {SQL_TOKENS}, {_SQL_SCHED}, {_SQL_KEEP} "
          "SELECT row_id, pos, t, keep_prob FROM kp")
def q_freq_aware_keep_prob(spark: SparkSession, d: str) -> DataFrame:
    """F16: survival at the document's step, tilted by centred word frequency."""
    kept = T.arrays_long(_keep(spark, d), ["keep_prob"], carry=("t",))
    return finish(kept.select("row_id", "pos", "t", "keep_prob"))


@register("corrupt_corpus", sql=f"WITH {SQL_TOKENS}, {_SQL_SCHED}, {_SQL_KEEP} "
          "SELECT row_id, pos, token_id, noised FROM noised2")
def q_corrupt_corpus(spark: SparkSession, d: str) -> DataFrame:
    """tokens that do not survive become the mask id (seeded md5 draw)."""
    kept = T.arrays_long(_keep(spark, d), ["token_id", "keep_prob"], carry=("t",))
    return T.corrupt(kept, SEED).select("row_id", "pos", "token_id", "noised")


@register("whole_word_mask", sql=f"WITH {SQL_TOKENS}, {_SQL_SCHED}, {_SQL_KEEP}, "
          "ww AS (SELECT n.row_id, n.pos, n.noised = " + str(TF.MASK_ID) + " AS masked, "
          "              NOT regexp_matches(w.word, '^[A-Z]') AS is_continuation "
          "       FROM noised2 n JOIN words w USING (row_id, pos)), "
          "ww2 AS (SELECT *, SUM(CASE WHEN is_continuation THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY pos "
          "        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS word_ix FROM ww) "
          "SELECT row_id, pos, masked, is_continuation, "
          "       first_value(masked) OVER (PARTITION BY row_id, word_ix ORDER BY pos "
          "       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ww_masked FROM ww2")
def q_whole_word_mask(spark: SparkSession, d: str) -> DataFrame:
    """W11 with words as pieces: a piece not starting with a capital continues
    the previous one; the corruption draw (F17) decides which heads are masked."""
    noised = T.corrupt(_keep(spark, d), SEED)
    pieces = noised.select("row_id", F.transform("noised", lambda x: x == TF.MASK_ID).alias("masked"),
                           F.col("word_continues").alias("is_continuation"))
    return T.whole_word_mask(pieces).select("row_id", "pos", "masked", "is_continuation", "ww_masked")


# ------------------------------------------------------------- candidates
_SQL_EMB = "emb AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z, label FROM embeddings)"


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"), "label")


@register("topk_candidates", sql=f"WITH {_SQL_EMB} SELECT vec_id, list_transform(z, lambda x: CASE WHEN x >= "
          f"list_sort(z, 'DESC')[least({T.TOP_K}, len(z))] THEN x ELSE CAST('-inf' AS DOUBLE) END) AS filtered "
          "FROM emb")
def q_topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Per embedding, scores below the 10th best become -inf."""
    return finish(_emb(spark, d).select("vec_id", T.topk_filter(F.col("z")).alias("filtered")))


@register("nucleus_candidates", sql=f"WITH {_SQL_EMB}, "
          "sm AS (SELECT vec_id, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM emb), "
          "pr AS (SELECT vec_id, z, list_transform(e, lambda x: x / list_sum(e)) AS p FROM sm), "
          "srt AS (SELECT vec_id, z, p, list_sort(p, 'DESC') AS s FROM pr), "
          "thr AS (SELECT vec_id, z, p, list_min(list_filter(list_transform(range(1, len(s) + 1), "
          f"  lambda i: CASE WHEN list_sum(s[1:i - 1]) IS NULL OR list_sum(s[1:i - 1]) < {NUCLEUS_P} THEN s[i] END), "
          "  lambda x: x IS NOT NULL)) AS th FROM srt) "
          "SELECT vec_id, list_transform(list_zip(z, p), lambda x: CASE WHEN x[2] >= th THEN x[1] "
          "ELSE CAST('-inf' AS DOUBLE) END) AS filtered FROM thr")
def q_nucleus_candidates(spark: SparkSession, d: str) -> DataFrame:
    """W10 with p = 0.9 over the 64 scores of each embedding."""
    return finish(_emb(spark, d).select("vec_id", T.nucleus_filter(F.col("z"), NUCLEUS_P).alias("filtered")))


@register("one_hot", sql="SELECT vec_id, list_transform(range(10), lambda i: CAST(i = label AS INTEGER)) AS onehot "
          "FROM embeddings")
def q_one_hot(spark: SparkSession, d: str) -> DataFrame:
    """class label to a 10-wide indicator."""
    return table(spark, d, "embeddings").select("vec_id", one_hot("label", 10).alias("onehot"))
