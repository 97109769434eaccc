"""Corpus metrics (A25, A26, J8, J10, C6) bound to ``conversations``.

Group = conversation, sentence = turn text (whitespace words).  For the
one-reference BLEU, the hypothesis is turn t and its reference turn t + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.tokens import split_words, token_diversity
from helixframe.operators import text as TX
from helixframe.plans.registry import finish, register
from helixframe.sources.tables import table

ORDERS = range(1, TX.MAX_ORDER + 1)
_ORD = "(SELECT unnest([" + ", ".join(str(n) for n in ORDERS) + "]) AS n)"

SQL_SENTS = (r"sents AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w "
             "FROM conversations)")


def sql_grams(src: str, keys: str, name: str) -> str:
    return (f"{name} AS (SELECT {keys}, n, gram, count(*) AS c FROM (SELECT {keys}, n, unnest(CASE WHEN len(w) - n + 1 >= 1 "
            f"THEN list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) "
            f"ELSE [] END) AS gram FROM {src}, {_ORD}) GROUP BY ALL)")


def sql_score(per: str, keys: str) -> str:
    """BLEU (method 4) from ``per`` rows (keys, n, num, den, hyp_len, ref_len)."""
    cols = ", ".join([f"max(CASE WHEN n = {n} THEN num END) AS num{n}" for n in ORDERS]
                     + [f"max(CASE WHEN n = {n} THEN den END) AS den{n}" for n in ORDERS])
    zs, ps = [], []
    for n in ORDERS:
        zero = f"coalesce(num{n}, 0) = 0"
        zs.append(f"(CASE WHEN {zero} AND hyp_len > 1 THEN 1 ELSE 0 END)")
        z = " + ".join(zs)
        p = (f"(CASE WHEN {zero} AND hyp_len > 1 THEN 1.0 / (pow(2.0, {z}) * {TX.METHOD4_K} / ln(hyp_len)) / greatest(coalesce(den{n}, 0), 1) "
             f"WHEN {zero} THEN 0.0 ELSE CAST(num{n} AS DOUBLE) / greatest(coalesce(den{n}, 0), 1) END)")
        ps.append(f"(CASE WHEN {p} > 0 THEN ln({p}) ELSE CAST('-inf' AS DOUBLE) END)")
    s = "(" + " + ".join(ps) + f") / {TX.MAX_ORDER}"
    bp = ("(CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 "
          "ELSE exp(1 - CAST(ref_len AS DOUBLE) / hyp_len) END)")
    return (f"SELECT {keys}, CASE WHEN coalesce(num1, 0) = 0 THEN 0.0 WHEN ref_len IS NULL THEN 0.0 "
            f"ELSE {bp} * exp({s}) END AS bleu FROM (SELECT {keys}, any_value(hyp_len) AS hyp_len, "
            f"any_value(ref_len) AS ref_len, {cols} FROM {per} GROUP BY ALL)")


SQL_SELF = (f"{SQL_SENTS}, {sql_grams('sents', 'conv_id, turn', 'counts')}, "
            "top AS (SELECT conv_id, n, gram, max(c) AS m1 FROM counts GROUP BY ALL), "
            "st AS (SELECT c.conv_id, c.n, c.gram, any_value(t.m1) AS m1, "
            "sum(CASE WHEN c.c = t.m1 THEN 1 ELSE 0 END) AS holders, "
            "coalesce(max(CASE WHEN c.c < t.m1 THEN c.c END), 0) AS m2 FROM counts c JOIN top t USING (conv_id, n, gram) "
            "GROUP BY ALL), "
            "loo AS (SELECT c.conv_id, c.turn, c.n, c.gram, c.c, CASE WHEN c.c = st.m1 AND st.holders = 1 THEN st.m2 "
            "ELSE st.m1 END AS ref_max FROM counts c JOIN st USING (conv_id, n, gram)), "
            "num AS (SELECT conv_id, turn, n, sum(least(c, ref_max)) AS num, sum(c) AS den FROM loo GROUP BY ALL), "
            "lens AS (SELECT conv_id, turn, len(w) AS hyp_len FROM sents), "
            "hist AS (SELECT conv_id, hyp_len, k, lag(hyp_len) OVER (PARTITION BY conv_id ORDER BY hyp_len) AS lo, "
            "lead(hyp_len) OVER (PARTITION BY conv_id ORDER BY hyp_len) AS hi FROM "
            "(SELECT conv_id, hyp_len, count(*) AS k FROM lens GROUP BY ALL)), "
            "refl AS (SELECT l.conv_id, l.turn, l.hyp_len, CASE WHEN k >= 2 THEN l.hyp_len WHEN lo IS NULL THEN hi "
            "WHEN hi IS NULL THEN lo WHEN l.hyp_len - lo <= hi - l.hyp_len THEN lo ELSE hi END AS ref_len "
            "FROM lens l JOIN hist h USING (conv_id, hyp_len)), "
            f"per AS (SELECT r.conv_id, r.turn, r.hyp_len, r.ref_len, o.n, num.num, num.den FROM refl r CROSS JOIN {_ORD} o "
            "LEFT JOIN num USING (conv_id, turn, n)), "
            f"scores AS ({sql_score('per', 'conv_id, turn')})")


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "text")


@register("leave_one_out_refs", sql=f"WITH {SQL_SELF} SELECT conv_id, turn, n, gram, c, ref_max FROM loo")
def q_leave_one_out_refs(spark: SparkSession, d: str) -> DataFrame:
    """Per sentence n-gram, the largest count among the other sentences."""
    counts = TX.sentence_ngrams(_conv(spark, d), ["conv_id", "turn"], "text", by=["conv_id"])
    return TX.leave_one_out_max(counts, ["conv_id"], ["conv_id", "turn"])


@register("self_bleu_sentences", sql=f"WITH {SQL_SELF} SELECT * FROM scores")
def q_self_bleu_sentences(spark: SparkSession, d: str) -> DataFrame:
    """A25 per sentence: BLEU-4 of each turn against all other turns."""
    return finish(TX.self_bleu_scores(_conv(spark, d), ["conv_id"], ["turn"], "text"))


@register("self_bleu", sql=f"WITH {SQL_SELF} SELECT conv_id, avg(bleu) AS self_bleu FROM scores GROUP BY conv_id")
def q_self_bleu(spark: SparkSession, d: str) -> DataFrame:
    """Mean self-BLEU per conversation."""
    return finish(TX.self_bleu(_conv(spark, d), ["conv_id"], ["turn"], "text"))


def _hyp_ref(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _conv(spark, d)
    hyp = c
    ref = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "text")  # reference of turn t is turn t+1
    keyed = hyp.join(ref.select("conv_id", "turn"), ["conv_id", "turn"])  # turns that have a successor
    return keyed, ref.join(keyed.select("conv_id", "turn"), ["conv_id", "turn"])


SQL_PAIRS = (r"hyp AS (SELECT h.conv_id, h.turn, list_filter(string_split_regex(h.text, '\s+'), lambda x: x <> '') AS w "
             "FROM conversations h JOIN conversations r ON r.conv_id = h.conv_id AND r.turn = h.turn + 1), "
             r"ref AS (SELECT r.conv_id, r.turn - 1 AS turn, list_filter(string_split_regex(r.text, '\s+'), "
             "lambda x: x <> '') AS w FROM conversations r JOIN conversations h ON h.conv_id = r.conv_id "
             "AND h.turn = r.turn - 1), "
             f"{sql_grams('hyp', 'conv_id, turn', 'hc')}, {sql_grams('ref', 'conv_id, turn', 'rc')}, "
             "rj AS (SELECT hc.conv_id, hc.turn, hc.n, CAST(sum(least(hc.c, coalesce(rc.c, 0))) AS BIGINT) AS num, "
             "CAST(sum(hc.c) AS BIGINT) AS den "
             "FROM hc LEFT JOIN rc USING (conv_id, turn, n, gram) GROUP BY ALL)")


@register("reference_bleu_join", sql=f"WITH {SQL_PAIRS} SELECT * FROM rj")
def q_reference_bleu_join(spark: SparkSession, d: str) -> DataFrame:
    """Clipped matches of turn t against turn t + 1, per order."""
    hyp, ref = _hyp_ref(spark, d)
    return TX.reference_join(hyp, ref, ["conv_id", "turn"])


@register("corpus_bleu", sql=f"WITH {SQL_PAIRS}, "
          "tot AS (SELECT n, sum(num) AS num, sum(den) AS den FROM rj GROUP BY n), "
          "lens AS (SELECT sum(len(hyp.w)) AS hyp_len, sum(len(ref.w)) AS ref_len FROM hyp JOIN ref USING (conv_id, turn)), "
          f"per AS (SELECT 0 AS k, o.n, tot.num, tot.den, lens.hyp_len, lens.ref_len FROM {_ORD} o "
          "LEFT JOIN tot USING (n) CROSS JOIN lens) "
          f"SELECT bleu AS corpus_bleu FROM ({sql_score('per', 'k')})")
def q_corpus_bleu(spark: SparkSession, d: str) -> DataFrame:
    """Corpus BLEU-4 of every turn against its successor."""
    hyp, ref = _hyp_ref(spark, d)
    return finish(TX.corpus_bleu(hyp, ref, ["conv_id", "turn"]))


@register("generation_quality", sql=f"WITH {SQL_SELF}, "
          "div AS (SELECT conv_id, avg(len(list_distinct(w)) / nullif(len(w), 0)) AS diversity FROM sents GROUP BY conv_id) "
          "SELECT conv_id, avg(bleu) AS self_bleu, any_value(diversity) AS diversity FROM scores JOIN div USING (conv_id) "
          "GROUP BY conv_id")
def q_generation_quality(spark: SparkSession, d: str) -> DataFrame:
    """Self-BLEU and token diversity of each conversation (the batch)."""
    c = _conv(spark, d)
    sb = TX.self_bleu(c, ["conv_id"], ["turn"], "text")
    div = c.select("conv_id", token_diversity(split_words("text")).alias("dv")).groupBy("conv_id") \
        .agg(F.avg("dv").alias("diversity"))
    return finish(sb.join(div.hint("merge"), "conv_id"))  # both grow with the conversations
