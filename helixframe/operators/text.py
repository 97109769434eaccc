"""Corpus BLEU and self-BLEU (A25, A26, J8, J10) without forming sentence pairs.

Definitions follow the public NLTK BLEU with smoothing method 4:
modified n-gram precision for n = 1..4 with denominators at least 1; score
0 when no unigram matches; an order with no match and hypothesis length
L > 1 gets 1 / (2^j * 5 / ln L), j counting such orders so far; brevity
penalty exp(1 - r/c) when c <= r, r the closest reference length (shorter
on ties); uniform weights 1/4.

Self-BLEU (every sentence against all the other sentences of its group)
needs, for each sentence and n-gram, the largest count among the *other*
sentences: the second of its group's counts of that n-gram in falling order
for the sentence that comes first, the first one for every other.  The
n-grams are exchanged once, by (group, n, gram), so a group is spread over
the cluster; no pairs are formed.

Joins between tables that grow are stated as merge joins: n-grams are made
from texts row by row, which the planner's size estimates do not see, and it
would collect a table many times its estimate to broadcast it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.tokens import ngrams, split_words
from helixframe.operators.ranking import _parts

# --- fixed values (published definition) ---
MAX_ORDER = 4
METHOD4_K = 5.0
# --- end of fixed values ---


def sentence_ngrams(df: DataFrame, keys: list[str], text: str, max_order: int = MAX_ORDER, by: list[str] | None = None) -> DataFrame:
    """``(keys..., n, gram, c)``: n-gram counts per sentence, spread by (``by``,
    n, gram) if given, some of the keys."""
    w = df.select(*keys, split_words(text).alias("__w"))
    grams = F.array(*[F.struct(F.lit(n).alias("__n"), ngrams("__w", n).alias("__g"))
                      for n in range(1, max_order + 1)])
    e = w.select(*keys, F.inline(grams)).select(*keys, F.col("__n").alias("n"), F.explode("__g").alias("gram"))
    if by is not None:
        e = e.repartition(*by, "n", "gram")
    return e.groupBy(*keys, "n", "gram").agg(F.count(F.lit(1)).alias("c"))


def sentence_lengths(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.size(split_words(text)).alias("hyp_len"))


def leave_one_out_max(counts: DataFrame, group: list[str], sent: list[str]) -> DataFrame:
    """For each sentence's n-gram, the largest count among the other
    sentences of its group (0 when none holds it)."""
    known = counts
    for c in group:
        known = known.where(F.col(c).isNotNull())
    falling = Window.partitionBy(*group, "n", "gram").orderBy(F.col("c").desc())
    first = F.row_number().over(falling) == 1
    loo = F.when(first, F.coalesce(F.lead("c").over(falling), F.lit(0))).otherwise(F.first("c").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return known.select(*group, *[s for s in sent if s not in group], "n", "gram", "c", loo.alias("ref_max"))


def closest_other_length(lengths: DataFrame, group: list[str], sent: list[str]) -> DataFrame:
    """Closest length among the *other* sentences of the group (shorter on
    ties), from the group's distinct-length histogram and its neighbours."""
    hist = lengths.groupBy(*group, "hyp_len").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*group).orderBy("hyp_len")
    hist = hist.select(*group, "hyp_len", "k", F.lag("hyp_len").over(w).alias("lo"),
                       F.lead("hyp_len").over(w).alias("hi"))
    j = lengths.join(hist.hint("merge"), [*group, "hyp_len"])
    L = F.col("hyp_len")
    pick = (F.when(F.col("k") >= 2, L)
            .when(F.col("lo").isNull(), F.col("hi"))
            .when(F.col("hi").isNull(), F.col("lo"))
            .when(L - F.col("lo") <= F.col("hi") - L, F.col("lo"))
            .otherwise(F.col("hi")))
    return j.select(*group, *[s for s in sent if s not in group], "hyp_len", pick.alias("ref_len"))


def bleu_from_counts(per_order: DataFrame, keys: list[str], max_order: int = MAX_ORDER) -> DataFrame:
    """Score from ``(keys..., n, num, den, hyp_len, ref_len)`` rows (one per order)."""
    wide = per_order.groupBy(*keys).agg(
        F.first("hyp_len").alias("hyp_len"), F.first("ref_len").alias("ref_len"),
        *[F.max(F.when(F.col("n") == n, F.col("num"))).alias(f"num{n}") for n in range(1, max_order + 1)],
        *[F.max(F.when(F.col("n") == n, F.col("den"))).alias(f"den{n}") for n in range(1, max_order + 1)])
    c = F.col("hyp_len").cast("double")
    zero_seen: Column = F.lit(0)
    logs = []
    for n in range(1, max_order + 1):
        num = F.coalesce(F.col(f"num{n}"), F.lit(0)).cast("double")
        den = F.greatest(F.coalesce(F.col(f"den{n}"), F.lit(0)), F.lit(1)).cast("double")
        zero = (num == 0)
        zero_seen = zero_seen + F.when(zero & (c > 1), 1).otherwise(0)
        # the smoothed count stands in for the numerator
        smoothed = F.lit(1.0) / (F.pow(F.lit(2.0), zero_seen) * METHOD4_K / F.log(c)) / den
        p = F.when(zero & (c > 1), smoothed).when(zero, F.lit(0.0)).otherwise(num / den)
        logs.append(F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf"))))
    s = sum(logs[1:], logs[0]) / max_order
    r = F.col("ref_len").cast("double")
    bp = F.when(c > r, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(1 - r / c))
    score = (F.when(F.coalesce(F.col("num1"), F.lit(0)) == 0, F.lit(0.0))
             .when(F.col("ref_len").isNull(), F.lit(0.0))
             .otherwise(bp * F.exp(s)))
    return wide.select(*keys, score.alias("bleu"))


def self_bleu_scores(df: DataFrame, group: list[str], sent: list[str], text: str) -> DataFrame:
    """Per-sentence self-BLEU: ``(group..., sent..., bleu)``."""
    keys = list(dict.fromkeys([*group, *sent]))
    counts = sentence_ngrams(df, keys, text, by=group)
    loo = leave_one_out_max(counts, group, keys)
    num = loo.groupBy(*keys, "n").agg(F.sum(F.least("c", "ref_max")).alias("num"), F.sum("c").alias("den"))
    lengths = sentence_lengths(df, keys, text)
    refl = closest_other_length(lengths, group, keys)
    orders = refl.crossJoin(F.broadcast(df.sparkSession.range(1, MAX_ORDER + 1)
                                        .select(F.col("id").cast("int").alias("n"))))  # 4 rows
    per = orders.join(num.hint("merge"), [*keys, "n"], "left")
    return bleu_from_counts(per, keys)


def self_bleu(df: DataFrame, group: list[str], sent: list[str], text: str) -> DataFrame:
    """Mean self-BLEU per group."""
    return self_bleu_scores(df, group, sent, text).groupBy(*group).agg(F.avg("bleu").alias("self_bleu"))


def reference_join(hyp: DataFrame, ref: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Clipped n-gram matches of each hypothesis against its one
    reference, their n-gram counts joined on (keys, n, gram).

    Both sides' texts are brought together by ``keys`` first, and each n-gram
    meets its counterpart as one group: texts are exchanged, n-grams never.
    Null keys match none."""
    sides = hyp.select(*keys, text, F.lit(True).alias("__hyp")).unionByName(ref.select(*keys, text, F.lit(False).alias("__hyp")))
    spread = sides.repartition(_parts(hyp, None), *keys)  # a number of its own: the n-grams are many times the texts
    counts = sentence_ngrams(spread, [*keys, "__hyp"], text)
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    j = counts.groupBy(*keys, "n", "gram").agg(F.sum(F.when(F.col("__hyp"), F.col("c"))).alias("c"), F.sum(F.when(~F.col("__hyp") & known, F.col("c"))).alias("rc"))
    return j.where(F.col("c").isNotNull()).groupBy(*keys, "n").agg(F.sum(F.least("c", F.coalesce("rc", F.lit(0)))).alias("num"),
                                                                   F.sum("c").alias("den"))


def corpus_bleu(hyp: DataFrame, ref: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Pooled clipped counts and lengths over all pairs, one score."""
    per = reference_join(hyp, ref, keys, text)
    tot = per.groupBy("n").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    hl = sentence_lengths(hyp, keys, text).withColumnRenamed("hyp_len", "h")
    rl = sentence_lengths(ref, keys, text).withColumnRenamed("hyp_len", "r")
    lens = hl.join(rl, keys).agg(F.sum("h").alias("hyp_len"), F.sum("r").alias("ref_len"))
    orders = hyp.sparkSession.range(1, MAX_ORDER + 1).select(F.col("id").cast("int").alias("n"))
    per_order = orders.join(tot, "n", "left").crossJoin(lens).withColumn("__k", F.lit(0))
    return bleu_from_counts(per_order, ["__k"]).select(F.col("bleu").alias("corpus_bleu"))

