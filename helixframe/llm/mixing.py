"""Soft-membership mixing: document rates whose expected token totals by
domain match targets.  DataFrame operations only.

1. A naive Bayes classifier of words predicts each document's posterior over
   the domains of a labelled table.  It is fitted on at most ``max_train``
   labelled rows (the smallest hashes of their ids; of a domain's texts with
   the same eight longest words (as near copies mostly have) one counts).  In the fit, a word counts once per document.  Kept is every word that is
   surely more frequent in a domain than elsewhere (z of at least ``least_z``) and
   much more frequent (``least_lift`` times).  A domain's score is the
   log-likelihood of the document's kept words against their rate over all
   domains; other words weigh nothing, and no sum is cut, however long the document.  A domain
   needs a kept word that speaks for it more than for any other: without one
   its posterior is 0, so that documents without evidence carry no share of a
   scarce domain.  The largest domain of the labels, the background, needs none.
2. Projected gradient descent (with momentum, restarted where it overshoots) on
   1/2 sum_k (S_k - T_k)^2 / M_k + lam/2 sum_i t_i (r_i - 1)^2,  0 <= r <= ``most``,
   where S_k = sum_i r_i t_i P_ik and M_k is the larger of the domain's target
   and its total at rate 1: a scarce domain counts by its own mass, not by its
   share of all tokens.  lam falls with the scarcest domain's total over its
   M_k, so that the pull to 1 is small beside every target.  A step needs only
   the K totals S_k, one aggregate over all documents; a document's rate follows
   from its own posterior and the K residuals of each step.  Steps go on until
   every gap (S_k - T_k) / M_k is within ``close``, or the totals stand still (a
   fiftieth of ``close`` in 16 steps) or ``steps`` are done: then a warning names the gaps, which are also returned.

Tokens are white-space delimited, lower-cased words; the classifier reads them
without the punctuation at either end (a word of nothing else stays).

Defined results: null and blank texts have no tokens and belong to the background; without
labelled rows every document has the prior; documents of null or repeated ids are rows like any other (a null
id is never labelled); rows of null domain are unlabelled; a domain that is
labelled but has no target has the target 0; without labelled rows every rate
is that of a single domain; other columns are ignored.
"""

from __future__ import annotations

import warnings
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import stored

MAX_TRAIN, LEAST_Z, LEAST_LIFT = 20_000, 6.0, 8.0
BROADCAST_WORDS = 200_000  # more kept words than these are joined by a shuffle
EDGES = r""".,;:!?"'`()[]{}<>|/\\*#$%&@~^_=+-"""
STEPS, LAMBDA, FOLD, CLOSE, MOST = 512, 1e-3, 8, 5e-3, 100.0


def words_of(text):
    """Lower-cased words of a text column, blank ones among them."""
    return F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     "), " ")


def _term(w):
    """A word as the classifier reads it."""
    bare = F.btrim(w, F.lit(EDGES))
    return F.when(bare != "", bare).otherwise(w)


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], max_train: int = MAX_TRAIN, least_z: float = LEAST_Z, least_lift: float = LEAST_LIFT) -> tuple[DataFrame, list[float], bool]:
    """(stored weights by word hash, prior by domain, whether any row was labelled).
    ``docs`` has (doc_id, text), ``labelled`` (doc_id, domain)."""
    k = len(domains)
    lab = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains)).dropDuplicates(["doc_id"])
    some = stored(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "train")
    train = docs.join(F.broadcast(some), "doc_id").select("doc_id", "domain", words_of(F.col("text")).alias("ws"))  # at most max_train rows
    ranked = F.sort_array(F.transform("ws", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    longest = F.slice(F.array_distinct(F.slice(ranked, 1, 256)), 1, 8)
    train = stored(train.withColumn("longest", longest), "texts")
    first = train.groupBy("domain", "longest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    train = train.join(first, "doc_id", "left_semi").select("doc_id", "domain", F.explode("ws").alias("w")).where("w != ''")
    train = train.select("doc_id", "domain", F.xxhash64(_term(F.col("w"))).alias("w")).distinct()
    by = [F.sum((F.col("domain") == d).cast("long")) for d in domains]
    count = stored(train.groupBy("w").agg(F.array(*by).alias("c"), F.count("*").alias("n")), "words")
    total = [float(x or 0) for x in count.agg(*[F.sum(F.col("c")[j]) for j in range(k)]).first()]
    rows = dict(some.groupBy("domain").count().collect())  # a row per domain
    every, prior = sum(total), [(rows.get(d, 0) + 1.0) / (sum(rows.values()) + k) for d in domains]
    sure = F.lit(False)
    for j in range(k):
        c, n = F.col("c")[j].cast("double"), F.col("n").cast("double")
        rate = (n + 1.0) / (every + 1.0)
        z = (c - total[j] * rate) / F.sqrt(F.lit(total[j]) * rate + 1.0)
        sure = sure | (z >= least_z) & (c * (every - total[j] + 1.0) >= least_lift * (n - c) * total[j])
    kept = stored(count.where(sure).select("w", "c", "n"), "kept")
    # each domain's rates are smoothed by one word dealt out at the rates of all domains
    rate = F.col("n") / F.lit(every)
    weight = F.array(*[F.log((F.col("c")[j] + rate) / F.lit(total[j] + 1.0)) - F.log(rate) for j in range(k)])
    return stored(kept.select("w", weight.alias("g")).withColumn("best", F.array_max("g")), "weights"), prior, bool(rows)


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], train_docs: DataFrame | None = None, max_train: int = MAX_TRAIN,
               least_z: float = LEAST_Z, least_lift: float = LEAST_LIFT) -> DataFrame:
    """``node, doc_id, draw, tokens, p`` per row of ``docs`` (node, doc_id, draw, text);
    ``labelled`` has (doc_id, domain) and names rows of ``train_docs`` (by default, ``docs``)."""
    k = len(domains)
    weights, prior, any_row = classifier(docs if train_docs is None else train_docs, labelled, domains, max_train, least_z, least_lift)
    if weights.count() <= BROADCAST_WORDS:
        weights = F.broadcast(weights)
    # a blank word keeps its row and counts for nothing: a text without words stays in the result
    word = docs.select("node", "doc_id", "draw", F.explode(words_of(F.col("text"))).alias("w")).withColumn("w", F.when(F.col("w") != "", F.xxhash64(_term(F.col("w")))))
    speaks = [F.max((F.col("g")[j] >= F.col("best")).cast("int")).alias(f"v{j}") for j in range(k)]
    found = word.join(weights, "w", "left")
    score = found.groupBy("node", "doc_id", "draw").agg(F.count("w").alias("tokens"), *[F.sum(F.col("g")[j]).alias(f"s{j}") for j in range(k)], *speaks)
    back = max(range(k), key=lambda j: prior[j])
    raw = [F.when(F.lit(j == back or not any_row) | (F.col(f"v{j}") == 1), F.coalesce(f"s{j}", F.lit(0.0)) + log(prior[j])) for j in range(k)]
    top = F.greatest(*raw) if k > 1 else raw[0]
    out = score.withColumn("e", F.array(*[F.coalesce(F.exp(x - top), F.lit(0.0)) for x in raw]))
    norm = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return out.select("node", "doc_id", "draw", "tokens", F.transform("e", lambda x: x / norm).alias("p"))


def fit_rates(soft: DataFrame, targets: list[float], steps: int = STEPS, lam: float = LAMBDA, close: float = CLOSE, most: float = MOST) -> DataFrame:
    """``soft`` with columns ``rate`` and ``gaps`` (what is left of each
    domain's gap, the same in all rows); targets are token totals by domain."""
    k = len(targets)
    state = soft.withColumn("r", F.lit(1.0)).withColumn("q", F.lit(1.0))
    total = float(soft.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return _with_gaps(soft.withColumn("rate", F.lit(1.0)), [-1.0 if t > 0 else 0.0 for t in targets], close)
    goal = [t / total for t in targets]
    done, t = [], 1.0

    def rated():
        step = lambda s, x: F.struct(
            F.least(F.lit(float(most)), F.greatest(F.lit(0.0), _at(s, x) - eta * (sum((F.col("p")[j] * x["e"][j] for j in range(1, k)), F.col("p")[0] * x["e"][0]) + lam * (_at(s, x) - 1.0)))).alias("r"), s["r"].alias("q"))
        if not done:
            return state
        steps_ = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in e]).alias("e"), F.lit(float(b)).alias("b")) for e, b in done])
        return state.withColumn("_s", F.aggregate(steps_, F.struct(F.col("r"), F.col("q")), step)).withColumn("r", F.col("_s.r")).withColumn("q", F.col("_s.q")).drop("_s")

    def _at(s, x):
        return s["r"] + x["b"] * (s["r"] - s["q"])

    sums = lambda df: [float(x or 0) / total for x in df.agg(*[F.sum(F.col("r") * F.col("tokens") * F.col("p")[j]) for j in range(k)]).first()]
    before = now = sums(state)
    past = [now]
    mass = [max(n, g) or 1.0 for n, g in zip(now, goal)]
    lam *= min((n / m for n, m in zip(now, mass) if n > 0), default=1.0)
    eta = 1.0 / (1.0 + lam)  # the residuals' part of the curvature is 1 at most, as M_k is not below S_k at rate 1
    gaps = lambda at: [(n - g) / m for n, g, m in zip(at, goal, mass)]
    for _ in range(steps):
        new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        b = (t - 1) / new
        t = new
        ahead = gaps([n + b * (n - o) for n, o in zip(now, before)])
        done.append((ahead, b))
        if len(done) == FOLD:
            state, done = stored(rated(), "rates"), []
        before, now = now, sums(rated())
        moved = [(n - o) / m for n, o, m in zip(now, before, mass)]
        past.append(now)
        still = len(past) > 2 * FOLD and max(abs(n - o) / m for n, o, m in zip(now, past[-1 - 2 * FOLD], mass)) <= close / 50
        if max(map(abs, gaps(now))) <= close or still:
            break
        if sum(e * x * m for e, x, m in zip(ahead, moved, mass)) > 0:  # uphill
            t = 1.0
    return _with_gaps(rated().withColumnRenamed("r", "rate").drop("q"), gaps(now), close)


def _with_gaps(df: DataFrame, gaps: list[float], close: float) -> DataFrame:
    if max(map(abs, gaps)) > close:
        warnings.warn(f"mixing: targets not met, relative gaps by domain {[float(f'{g:.4g}') for g in gaps]}", stacklevel=3)
    return df.withColumn("gaps", F.array(*[F.lit(float(g)) for g in gaps]))


def mix_documents(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
                  budget: float | None = None, relative: bool = False, train_docs: DataFrame | None = None, most: float = MOST, **options) -> DataFrame:
    """``node, doc_id, draw, tokens, p, rate, gaps, domain`` per input row (node
    numbers the rows; draw is a hash of id and text, the same however the rows
    are partitioned).  ``weights`` are the domains' shares of the token budget (by
    default, all tokens of the input); if ``relative``, factors on the expected
    totals that the domains have in the input.  ``train_docs``
    are the labelled documents, if others than ``docs``."""
    domains = list(weights)
    named = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    rows = docs.select(F.monotonically_increasing_id().alias("node"), *named).withColumn("draw", F.xxhash64("doc_id", "text"))
    soft = stored(posteriors(rows, labelled, domains, None if train_docs is None else train_docs.select(*named), **options), "posteriors")
    sums = soft.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("p")[j]) for j in range(len(domains))]).first()
    total = budget if budget is not None else float(sums[0] or 0)
    if relative:
        targets = [float(x or 0) * weights[d] for x, d in zip(sums[1:], domains)]
    else:
        share = sum(weights.values()) or 1.0
        targets = [total * w / share for w in weights.values()]
    top = F.array_max(F.transform("p", lambda x, j: F.struct(x.alias("x"), (-j).alias("j"))))["j"]
    return fit_rates(soft, targets, most=most).withColumn("domain", F.array(*[F.lit(d) for d in domains])[-top])


def copies(rate, draw):
    """How often a row is taken: the rate's whole part, and once more with the
    chance of the rest, decided by the row's hash."""
    u = F.pmod(F.xxhash64(draw, F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + u).cast("long")
