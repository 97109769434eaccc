"""Evaluation metrics as distributed aggregates.

Every metric is a grouping with map-side partial aggregation that ends in a
handful of rows; nothing is collected to the driver and no per-row Python
runs, except the Student-t tail probability on a one-row result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from helixframe.functions.numeric import logsumexp
from helixframe.operators.ranking import average_rank, global_cumsum, running_sums

# --- fixed values (published defaults) ---
HIST_BINS = 30
HIST_EPS = 1e-10
LOG_LOSS_EPS = 1e-15
# --- end of fixed values ---


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


# ------------------------------------------------------------------ losses
def weighted_mean(df: DataFrame, val: str, n: str, by: list[str] | None = None,
                  name: str = "weighted_mean") -> DataFrame:
    """sum(val * n) / sum(n)."""
    expr = (F.sum(F.col(val) * F.col(n)) / F.sum(n)).alias(name)
    return df.groupBy(*by).agg(expr) if by else df.agg(expr)


def running_weighted_mean(df: DataFrame, by: list[str], order: list[Column], val: str, n: str,
                          name: str = "running_mean") -> DataFrame:
    """Weighted mean after each step, per run, skew-safe (see running_sums).

    The running sums are accumulated in DECIMAL(38,10), so the result does
    not depend on how the rows were split into ranges (float sums would
    differ in the last bits between partitionings)."""
    num = F.col(val).cast("decimal(38,10)") * F.col(n).cast("decimal(20,0)")
    sums = running_sums(df, by, order, {"__num": num, "__den": F.col(n).cast("long")})
    return sums.withColumn(name, F.col("__num").cast("double") / F.col("__den")).drop("__num", "__den")


def bce_with_logits(df: DataFrame, z: str, y: str, name: str = "bce") -> DataFrame:
    """Mean of max(z,0) - z*y + ln(1 + exp(-|z|))."""
    zc, yc = F.col(z), F.col(y)
    return df.agg(F.avg(F.greatest(zc, F.lit(0.0)) - zc * yc + F.log1p(F.exp(-F.abs(zc)))).alias(name))


def softmax_cross_entropy(df: DataFrame, logits: str, y: str, name: str = "cross_entropy") -> DataFrame:
    """Mean of logsumexp(z) - z[y]."""
    return df.agg(F.avg(logsumexp(logits) - F.element_at(logits, F.col(y) + 1)).alias(name))


def mse(df: DataFrame, y: str, p: str, name: str = "mse") -> DataFrame:
    """A10."""
    e = F.col(y) - F.col(p)
    return df.agg(F.avg(e * e).alias(name))


def log_loss(df: DataFrame, y: str, prob: str, eps: float = LOG_LOSS_EPS, name: str = "log_loss", by: list[str] | None = None) -> DataFrame:
    """Mean negative log-likelihood, probabilities clipped to [eps, 1-eps]; per group with ``by``."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*(by or [])).agg(F.avg(-(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))).alias(name))


# ------------------------------------------------------- classification
def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """A11."""
    return df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """A12 from 0/1 predictions: accuracy, precision, recall, F1, MCC
    (undefined ratios are 0, as with zero_division=0); per group with ``by``."""
    yc, pc = F.col(y), F.col(pred)
    by = by or []
    c = df.groupBy(*by).agg(F.sum(((yc == 1) & (pc == 1)).cast("long")).alias("tp"),
               F.sum(((yc == 0) & (pc == 1)).cast("long")).alias("fp"),
               F.sum(((yc == 0) & (pc == 0)).cast("long")).alias("tn"),
               F.sum(((yc == 1) & (pc == 0)).cast("long")).alias("fn"))
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    denom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        *by, "tp", "fp", "tn", "fn",
        _safe_div(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _safe_div(tp, tp + fp).alias("precision"),
        _safe_div(tp, tp + fn).alias("recall"),
        _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _safe_div(tp * tn - fp * fn, denom).alias("mcc"))


def _score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"),
        F.sum((F.col(y) != 1).cast("long")).alias("neg"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """One point per distinct score (descending) plus the origin with a
    null threshold.  Scores are aggregated first, then both counts are
    cumulated in one range-partitioned pass (no single-partition window)."""
    counts = _score_counts(df, y, score)
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = running_sums(counts, [], [F.col("threshold").desc()], {"cp": F.col("pos"), "cn": F.col("neg")})
    pts = cum.crossJoin(F.broadcast(totals)).select(
        "threshold",
        _safe_div(F.col("cn").cast("double"), F.col("N")).alias("fpr"),
        _safe_div(F.col("cp").cast("double"), F.col("P")).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(origin.select(F.col("threshold").cast(dict(pts.dtypes)["threshold"]), "fpr", "tpr"))


def auc(df: DataFrame, y: str, score: str, name: str = "auc") -> DataFrame:
    """Trapezoid area under A13.  Each distinct score adds
    neg/N * (2*cp_before + pos) / (2P), so no lag over the curve is needed."""
    counts = _score_counts(df, y, score)
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = global_cumsum(counts, [F.col("threshold").desc()], "pos", "cp_before")
    area = (F.col("neg") / F.col("N")) * (2 * F.col("cp_before") + F.col("pos")) / (2 * F.col("P"))
    return cum.crossJoin(F.broadcast(totals)).agg(F.sum(area).alias(name))


def grouped_auc(df: DataFrame, y: str, score: str, by: list[str], name: str = "auc") -> DataFrame:
    """A14 per group: what share of (positive, negative) pairs the score puts
    in order, ties half.  Scores are counted first; a group's counts are
    cumulated over as many ranges as they need.  Null without both classes."""
    counts = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    cum = running_sums(counts, by, [F.col("threshold").desc()], {"cp": F.col("pos")})
    total = cum.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("neg") * (2 * F.col("cp") - F.col("pos"))).alias("twice"))
    return total.select(*by, F.try_divide(F.col("twice") / 2, F.col("P") * F.col("N")).alias(name))


def multiclass_macro(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy and macro precision / recall / F1 over every class seen
    in truth or prediction (undefined = 0)."""
    cm = confusion_matrix(df, y, p)
    truth = cm.groupBy(F.col("y_true").alias("k")).agg(F.sum("n").alias("t"))
    pred = cm.groupBy(F.col("y_pred").alias("k")).agg(F.sum("n").alias("pp"))
    diag = cm.where(F.col("y_true") == F.col("y_pred")).select(F.col("y_true").alias("k"), F.col("n").alias("tp"))
    per = (truth.join(pred, "k", "full").join(diag, "k", "left")
                .select("k", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("t", "pp", "tp")]))
    per = per.select(_safe_div(F.col("tp"), F.col("pp")).alias("prec"),
                     _safe_div(F.col("tp"), F.col("t")).alias("rec"),
                     _safe_div(2 * F.col("tp"), F.col("t") + F.col("pp")).alias("f1"),
                     "tp", "t")
    return per.agg((F.sum("tp") / F.sum("t")).alias("accuracy"),
                   F.avg("prec").alias("macro_precision"), F.avg("rec").alias("macro_recall"),
                   F.avg("f1").alias("macro_f1"))


def multiclass_mcc(df: DataFrame, y: str, p: str, name: str = "mcc") -> DataFrame:
    """(c*s - sum t_k p_k) / sqrt((s^2 - sum p_k^2)(s^2 - sum t_k^2)); 0 when undefined."""
    cm = confusion_matrix(df, y, p)
    truth = cm.groupBy(F.col("y_true").alias("k")).agg(F.sum("n").alias("t"))
    pred = cm.groupBy(F.col("y_pred").alias("k")).agg(F.sum("n").alias("pp"))
    marg = truth.join(pred, "k", "full").select(F.coalesce("t", F.lit(0)).cast("double").alias("t"),
                                                F.coalesce("pp", F.lit(0)).cast("double").alias("pp"))
    m = marg.agg(F.sum(F.col("t") * F.col("pp")).alias("tp_sum"), F.sum(F.col("t") ** 2).alias("t2"),
                 F.sum(F.col("pp") ** 2).alias("p2"), F.sum("t").alias("s"))
    c = cm.agg(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).cast("double")
               .alias("c"))
    j = m.crossJoin(c)
    num = F.col("c") * F.col("s") - F.col("tp_sum")
    den = F.sqrt((F.col("s") ** 2 - F.col("p2")) * (F.col("s") ** 2 - F.col("t2")))
    return j.select(_safe_div(num, den).alias(name))


def fold_mean(per_fold: DataFrame, metrics: list[str], fold: str = "fold") -> DataFrame:
    """Unweighted mean over folds."""
    return per_fold.agg(*[F.avg(m).alias(m) for m in metrics])


# ----------------------------------------------------------- regression
def complete_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that have both values; every two-column statistic is one of these."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull())


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """R2 = 1 - SSE/SST (not the squared correlation), MSE, RMSE, MAE."""
    e = F.col(y) - F.col(p)
    a = complete_pairs(df, y, p).agg(F.sum(e * e).alias("sse"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
               (F.var_pop(y) * F.count(F.lit(1))).alias("sst"))
    return a.select((1 - _safe_div(F.col("sse"), F.col("sst"), float("nan"))).alias("r2"), "mse",
                    F.sqrt("mse").alias("rmse"), "mae")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """R from population covariance and deviations (guarded against a
    constant column instead of letting ANSI raise), t = r sqrt((n-2)/(1-r^2))."""
    a = complete_pairs(df, x, y).agg(F.covar_pop(x, y).alias("cov"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"),
               F.count(F.lit(1)).alias("n"))
    r = F.try_divide(F.col("cov"), F.col("sx") * F.col("sy"))
    out = a.select(r.alias("r"), "n")
    return out.select("r", "n", (F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") ** 2)))
                      .alias("t"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson of average-tie ranks."""
    ranked = average_rank(average_rank(complete_pairs(df.select(x, y), x, y), x, "__rx"), y, "__ry")
    return pearson(ranked, "__rx", "__ry").withColumnRenamed("r", "rho")


def _betacf(a: float, b: float, x: float) -> float:
    # Continued fraction for the regularised incomplete beta (modified Lentz).
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided Student-t tail probability: I_{dof/(dof+t^2)}(dof/2, 1/2)."""
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return regularized_beta(dof / 2.0, 0.5, dof / (dof + t * t))


@F.pandas_udf(DoubleType())
def t_pvalue_udf(t: pd.Series, n: pd.Series) -> pd.Series:
    """Arrow-batched helper for the one-row correlation results."""
    return pd.Series([t_two_sided_p(None if pd.isna(a) else float(a), float(b) - 2.0) for a, b in zip(t, n)])


def with_pvalue(corr: DataFrame) -> DataFrame:
    return corr.withColumn("p_value", t_pvalue_udf("t", "n"))


def regression_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """The ten scalars of a validation step as one row: loss (the mean squared
    error), A18, both correlations with their p-values, and the divergence
    of the shared histograms."""
    rm = regression_metrics(df, y, p).withColumn("loss", F.col("mse"))
    pe = with_pvalue(pearson(df, y, p)).select(F.col("r").alias("pearson"), F.col("p_value").alias("pearson_p"))
    sp = with_pvalue(spearman(df, y, p)).select(F.col("rho").alias("spearman"), F.col("p_value").alias("spearman_p"))
    h = shared_histogram(df, y, p)
    kl = kl_divergence(h, f"density_{y}", f"density_{p}")
    return rm.crossJoin(pe).crossJoin(sp).crossJoin(kl)


# ------------------------------------------------------------ histograms
def shared_histogram(df: DataFrame, a: str, b: str, bins: int = HIST_BINS) -> DataFrame:
    """Both columns on the same equal-width edges from the joint min to
    the joint max (last bin closed), density-normalised; empty bins exist.
    Only rows with both values count; when all values are equal, the range is
    widened by a half on either side."""
    spark = df.sparkSession
    df = complete_pairs(df, a, b)
    rng = df.agg(F.least(F.min(a), F.min(b)).alias("lo"), F.greatest(F.max(a), F.max(b)).alias("hi"),
                 F.count(F.lit(1)).alias("n"))
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    rng = rng.select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"), "n")
    width = (F.col("hi") - F.col("lo")) / bins

    def binned(col: str) -> Column:
        idx = F.floor((F.col(col) - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo"))))
        return F.least(idx, F.lit(bins - 1)).cast("int")

    x = df.select(a, b).crossJoin(F.broadcast(rng))
    ha = x.groupBy(binned(a).alias("bin")).agg(F.count(F.lit(1)).alias("ca"))
    hb = x.groupBy(binned(b).alias("bin")).agg(F.count(F.lit(1)).alias("cb"))
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin"))  # bin count, a parameter
    return (spine.join(ha, "bin", "left").join(hb, "bin", "left").crossJoin(F.broadcast(rng))
                 .select("bin",
                         (F.coalesce("ca", F.lit(0)) / (F.col("n") * width)).alias(f"density_{a}"),
                         (F.coalesce("cb", F.lit(0)) / (F.col("n") * width)).alias(f"density_{b}")))


def kl_divergence(hist: DataFrame, p: str, q: str, eps: float = HIST_EPS, name: str = "kl") -> DataFrame:
    """Add eps to both densities, renormalise, sum p ln(p/q) (p = truth)."""
    s = hist.agg(F.sum(F.col(p) + eps).alias("sp"), F.sum(F.col(q) + eps).alias("sq"))
    pn = (F.col(p) + eps) / F.col("sp")
    qn = (F.col(q) + eps) / F.col("sq")
    return hist.crossJoin(F.broadcast(s)).agg(F.sum(pn * F.log(pn / qn)).alias(name))
