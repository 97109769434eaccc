"""Metric queries (2.4 A7-A22, 2.5 W1, W8, 2.6 O2, 2.8 F10-F14).

Bindings: binary scores = documents x labels (truth quality, logit
(n_chars - 1500) / 1000); class logits = the first 10 embedding values with
truth = label; regression pairs = lineitem (y = extended price, prediction =
quantity * 1500); loss batches = events (run = event type, weight
1 + user_id mod 7, order = ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import numeric as N
from helixframe.operators import metrics as M
from helixframe.operators.ranking import average_rank
from helixframe.plans.registry import finish, register
from helixframe.sources.tables import table

# --- fixed values of the bindings ---
HEAD_WEIGHTS = [((j % 7) - 3) / 10.0 for j in range(64)]
HEAD_BIAS = 0.1
# --- end of fixed values ---

DBL = "CAST({} AS DOUBLE)"


# ---------------------------------------------------------------- bindings
def _binary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    return docs.join(lab, "doc_id").select("doc_id", "y", ((F.col("n_chars") - 1500) / 1000.0).alias("z"))


SQL_BIN = ("bin AS (SELECT d.doc_id, l.quality AS y, CAST(d.n_chars - 1500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS z "
           "FROM documents d JOIN labels l USING (doc_id)), "
           "binp AS (SELECT *, 1.0 / (1.0 + exp(-z)) AS prob, "
           "CAST(round_even(1.0 / (1.0 + exp(-z)), 0) AS INTEGER) AS pred FROM bin)")


def _binary_pred(spark: SparkSession, d: str) -> DataFrame:
    return _binary(spark, d).withColumn("prob", N.sigmoid("z")).withColumn("pred", N.sigmoid_class("z"))


def _logits(step: int, mod: int, mid: int):
    """Ten logits of the whole embedding, by literal heads: weight of value i
    (from 1) in head k (from 0) is ((i * step + i * k + k) mod ``mod``) - ``mid``."""
    def head(k):
        parts = F.transform("embedding", lambda x, i: x.cast("double") * (((i + 1) * (step + k) + k) % mod - mid))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(9)), head)


def _sql_logits(step: int, mod: int, mid: int) -> str:
    return (f"list_transform(range(0, 10), lambda k: list_sum(list_transform(range(1, 65), lambda i: "
            f"CAST(embedding[i] AS DOUBLE) * ((i * ({step} + k) + k) % {mod} - {mid}))))")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", _logits(1, 7, 3).alias("z"), F.col("label").alias("y")).withColumn("pred", N.argmax("z"))


SQL_CLS = ("cls AS (SELECT vec_id, z, label AS y, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred FROM "
           f"(SELECT vec_id, {_sql_logits(1, 7, 3)} AS z, label FROM embeddings))")


def _regression(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"),
                                              (F.col("l_quantity") * 1500).alias("pred"))


SQL_REG = ("reg AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * 1500 AS pred "
           "FROM lineitem)")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("run"),
                                            F.col("value").alias("val"), (1 + F.col("user_id") % 7).alias("n"))


SQL_RUNS = ("runs AS (SELECT event_id, ts, event_type AS run, value AS val, 1 + user_id % 7 AS n FROM events)")


def sql_softmax(z: str) -> str:
    return (f"list_transform(list_transform({z}, lambda v: exp(v - list_max({z}))), "
            f"lambda e: e / list_sum(list_transform({z}, lambda v: exp(v - list_max({z})))))")


# ----------------------------------------------------------------- losses
@register("weighted_mean_loss", sql=f"WITH {SQL_RUNS} SELECT run, sum(val * n) / sum(n) AS weighted_mean "
          "FROM runs GROUP BY run")
def q_weighted_mean_loss(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.weighted_mean(_runs(spark, d), "val", "n", ["run"]))


@register("running_mean_loss", sql=f"WITH {SQL_RUNS} SELECT event_id, run, "
          "CAST(sum(CAST(val AS DECIMAL(38,10)) * CAST(n AS DECIMAL(20,0))) OVER w AS DOUBLE) / sum(n) OVER w "
          "AS running_mean FROM runs "
          "WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def q_running_mean_loss(spark: SparkSession, d: str) -> DataFrame:
    r = M.running_weighted_mean(_runs(spark, d), ["run"], [F.col("ts"), F.col("event_id")], "val", "n")
    return finish(r.select("event_id", "run", "running_mean"))


@register("bce_with_logits", sql=f"WITH {SQL_BIN} SELECT avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS bce "
          "FROM bin")
def q_bce_with_logits(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.bce_with_logits(_binary(spark, d), "z", "y"))


@register("softmax_cross_entropy", sql=f"WITH {SQL_CLS} SELECT avg(list_max(z) + ln(list_sum(list_transform(z, "
          "lambda v: exp(v - list_max(z))))) - z[y + 1]) AS cross_entropy FROM cls")
def q_softmax_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.softmax_cross_entropy(_classes(spark, d), "z", "y"))


@register("mse_loss", sql=f"WITH {SQL_REG} SELECT avg((y - pred) * (y - pred)) AS mse FROM reg")
def q_mse_loss(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.mse(_regression(spark, d), "y", "pred"))


@register("log_loss_proba", sql=f"WITH {SQL_BIN} SELECT avg(-(y * ln(pc) + (1 - y) * ln(1 - pc))) AS log_loss "
          "FROM (SELECT y, least(greatest(prob, 1e-15), 1 - 1e-15) AS pc FROM binp)")
def q_log_loss_proba(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.log_loss(_binary_pred(spark, d), "y", "prob"))


# ---------------------------------------------------------- classification
@register("confusion_matrix", sql=f"WITH {SQL_CLS} SELECT y AS y_true, pred AS y_pred, count(*) AS n FROM cls "
          "GROUP BY ALL")
def q_confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion_matrix(_classes(spark, d), "y", "pred")


_SQL_BINM = ("SELECT tp, fp, tn, fn, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, "
             "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, "
             "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, "
             "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc "
             "FROM (SELECT CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, "
             "CAST(sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, "
             "CAST(sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, "
             "CAST(sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM {src})")


@register("binary_metrics", sql=f"WITH {SQL_BIN} SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
          "CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, accuracy, precision, recall, f1, mcc FROM ("
          + _SQL_BINM.format(src="binp") + ")")
def q_binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A12 from logits: sigmoid, half-to-even class, then the five metrics."""
    return finish(M.binary_metrics(_binary_pred(spark, d), "y", "pred"))


@register("sigmoid_class", sql="SELECT doc_id, 1.0 / (1.0 + exp(-z)) AS prob, "
          "CAST(round_even(1.0 / (1.0 + exp(-z)), 0) AS INTEGER) AS cls FROM (SELECT doc_id, "
          "CAST(n_chars - 1500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS z FROM documents)")
def q_sigmoid_class(spark: SparkSession, d: str) -> DataFrame:
    """F10 over every document's logit."""
    docs = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") - 1500) / 1000.0).alias("z"))
    return finish(docs.select("doc_id", N.sigmoid("z").alias("prob"), N.sigmoid_class("z").alias("cls")))


_SQL_ROC_COUNTS = ("rc AS (SELECT z AS threshold, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, "
                   "sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS neg FROM bin GROUP BY z), "
                   "rt AS (SELECT sum(pos) AS P, sum(neg) AS N FROM rc), "
                   "rcum AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED "
                   "PRECEDING AND 1 PRECEDING), 0) AS cp_before, coalesce(sum(neg) OVER (ORDER BY threshold DESC "
                   "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cn_before FROM rc)")


@register("roc_curve", sql=f"WITH {SQL_BIN}, {_SQL_ROC_COUNTS} "
          "SELECT threshold, CAST((cn_before + neg) AS DOUBLE) / N AS fpr, CAST((cp_before + pos) AS DOUBLE) / P AS tpr "
          "FROM rcum, rt UNION ALL SELECT NULL, 0.0, 0.0")
def q_roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.roc_curve(_binary(spark, d), "y", "z"))


@register("auc", sql=f"WITH {SQL_BIN}, {_SQL_ROC_COUNTS} "
          "SELECT sum((CAST(neg AS DOUBLE) / N) * (2 * cp_before + pos) / (2 * P)) AS auc FROM rcum, rt")
def q_auc(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.auc(_binary(spark, d), "y", "z"))


_SQL_MARG = ("cm AS (SELECT y AS y_true, pred AS y_pred, count(*) AS n FROM cls GROUP BY ALL), "
             "tr AS (SELECT y_true AS k, sum(n) AS t FROM cm GROUP BY 1), "
             "pr AS (SELECT y_pred AS k, sum(n) AS pp FROM cm GROUP BY 1), "
             "dg AS (SELECT y_true AS k, n AS tp FROM cm WHERE y_true = y_pred), "
             "per AS (SELECT coalesce(tr.k, pr.k) AS k, CAST(coalesce(t, 0) AS DOUBLE) AS t, "
             "CAST(coalesce(pp, 0) AS DOUBLE) AS pp FROM tr FULL JOIN pr ON tr.k = pr.k), "
             "per2 AS (SELECT per.*, CAST(coalesce(dg.tp, 0) AS DOUBLE) AS tp FROM per LEFT JOIN dg USING (k))")


@register("multiclass_macro", sql=f"WITH {SQL_CLS}, {_SQL_MARG} SELECT sum(tp) / sum(t) AS accuracy, "
          "avg(coalesce(tp / nullif(pp, 0), 0)) AS macro_precision, avg(coalesce(tp / nullif(t, 0), 0)) AS macro_recall, "
          "avg(coalesce(2 * tp / nullif(t + pp, 0), 0)) AS macro_f1 FROM per2")
def q_multiclass_macro(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.multiclass_macro(_classes(spark, d), "y", "pred"))


@register("multiclass_mcc", sql=f"WITH {SQL_CLS}, {_SQL_MARG} SELECT coalesce((sum(tp) * sum(t) - sum(t * pp)) / "
          "nullif(sqrt((sum(t) * sum(t) - sum(pp * pp)) * (sum(t) * sum(t) - sum(t * t))), 0), 0) AS mcc FROM per2")
def q_multiclass_mcc(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.multiclass_mcc(_classes(spark, d), "y", "pred"))


@register("argmax_class", sql=f"WITH {SQL_CLS} SELECT vec_id, pred FROM cls")
def q_argmax_class(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("vec_id", "pred")


@register("softmax", sql=f"WITH {SQL_CLS} SELECT vec_id, {sql_softmax('z')} AS probs FROM cls")
def q_softmax(spark: SparkSession, d: str) -> DataFrame:
    return finish(_classes(spark, d).select("vec_id", N.softmax("z").alias("probs")))


_SQL_PQ = (f"pq AS (SELECT vec_id, label, {sql_softmax('z1')} AS p, {sql_softmax('z2')} AS q FROM "
           f"(SELECT vec_id, label, {_sql_logits(1, 7, 3)} AS z1, {_sql_logits(2, 5, 2)} AS z2 FROM embeddings))")


def _pq(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    z1, z2 = _logits(1, 7, 3), _logits(2, 5, 2)
    return e.select("vec_id", "label", N.softmax(z1).alias("p"), N.softmax(z2).alias("q"))


@register("categorical_kl", sql=f"WITH {_SQL_PQ} SELECT vec_id, greatest(list_sum(list_transform(range(1, 11), "
          "lambda i: p[i] * (ln(p[i] + 1e-20) - ln(q[i] + 1e-20)))), 0) AS kl FROM pq")
def q_categorical_kl(spark: SparkSession, d: str) -> DataFrame:
    return finish(_pq(spark, d).select("vec_id", N.categorical_kl("p", "q").alias("kl")))


@register("categorical_xent", sql=f"WITH {_SQL_PQ} SELECT vec_id, -ln(greatest(p[label + 1], 0) + 1e-20) AS xent "
          "FROM pq")
def q_categorical_xent(spark: SparkSession, d: str) -> DataFrame:
    return finish(_pq(spark, d).select("vec_id", N.categorical_xent("p", "label").alias("xent")))


_W_SQL = "[" + ", ".join(f"CAST({w!r} AS DOUBLE)" for w in HEAD_WEIGHTS) + "]"


@register("linear_head", sql=f"SELECT vec_id, {HEAD_BIAS!r} + list_sum(list_transform(range(1, 65), "
          f"lambda i: CAST(embedding[i] AS DOUBLE) * ({_W_SQL})[i])) AS score FROM embeddings")
def q_linear_head(spark: SparkSession, d: str) -> DataFrame:
    """F14 over the 64-wide pooled vector."""
    e = table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return finish(e.select("vec_id", N.linear_head(v, HEAD_WEIGHTS, HEAD_BIAS).alias("score")))


# -------------------------------------------------------------- regression
@register("regression_metrics", sql=f"WITH {SQL_REG} SELECT 1 - sse / nullif(sst, 0) AS r2, mse, sqrt(mse) AS rmse, "
          "mae FROM (SELECT sum((y - pred) * (y - pred)) AS sse, avg((y - pred) * (y - pred)) AS mse, "
          "avg(abs(y - pred)) AS mae, var_pop(y) * count(*) AS sst FROM reg)")
def q_regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.regression_metrics(_regression(spark, d), "y", "pred"))


@register("pearson_r", sql=f"WITH {SQL_REG} SELECT r, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM "
          "(SELECT corr(y, pred) AS r, count(*) AS n FROM reg)")
def q_pearson_r(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.pearson(_regression(spark, d), "y", "pred"))


def sql_p_value(t: str, n: str) -> str:
    """Two-sided tail of Student's t with n - 2 degrees of freedom: the share of
    the integral of cos^(n - 3) that lies beyond atan(t / sqrt(n - 2)), by Simpson's rule."""
    k = 1_000_000

    def integral(low: str) -> str:
        x = f"({low} + (pi() / 2 - {low}) * i / {k})"
        return (f"(SELECT (pi() / 2 - {low}) * sum(CASE WHEN i = 0 OR i = {k} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * "
                f"pow(greatest(cos({x}), 0), {n} - 3)) FROM range({k + 1}) s(i))")

    return f"({integral(f'atan(abs({t}) / sqrt({n} - 2))')} / {integral('CAST(0 AS DOUBLE)')})"


@register("pearson_pvalue", sql=f"WITH {SQL_REG}, c AS (SELECT corr(y, pred) AS r, count(*) AS n FROM reg), "
          "ct AS (SELECT r, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c) "
          f"SELECT r, n, t, {sql_p_value('(SELECT t FROM ct)', '(SELECT n FROM ct)')} AS p_value FROM ct")
def q_pearson_pvalue(spark: SparkSession, d: str) -> DataFrame:
    """A19 with its two-sided p-value (incomplete beta on the one-row result)."""
    return finish(M.with_pvalue(M.pearson(_regression(spark, d), "y", "pred")))


_SQL_RANKS = ("rk AS (SELECT (rank() OVER (ORDER BY y) + rank() OVER (ORDER BY y) + count(*) OVER (PARTITION BY y) - 1)"
              " / 2.0 AS ry, (rank() OVER (ORDER BY pred) + rank() OVER (ORDER BY pred) + "
              "count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS rp FROM reg)")


@register("spearman_r", sql=f"WITH {SQL_REG}, {_SQL_RANKS} SELECT rho, n, rho * sqrt((n - 2) / (1 - rho * rho)) AS t "
          "FROM (SELECT corr(ry, rp) AS rho, count(*) AS n FROM rk)")
def q_spearman_r(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.spearman(_regression(spark, d), "y", "pred"))


@register("spearman_pvalue", sql=f"WITH {SQL_REG}, {_SQL_RANKS}, c AS (SELECT corr(ry, rp) AS rho, count(*) AS n FROM rk), "
          "ct AS (SELECT rho, n, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c) "
          f"SELECT rho, n, t, {sql_p_value('(SELECT t FROM ct)', '(SELECT n FROM ct)')} AS p_value FROM ct")
def q_spearman_pvalue(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.with_pvalue(M.spearman(_regression(spark, d), "y", "pred")))


@register("average_rank", sql=f"WITH {SQL_REG} SELECT l_orderkey, l_linenumber, (rank() OVER (ORDER BY y) + "
          "rank() OVER (ORDER BY y) + count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rank FROM reg")
def q_average_rank(spark: SparkSession, d: str) -> DataFrame:
    """W8 on the extended price."""
    return finish(average_rank(_regression(spark, d), "y").select("l_orderkey", "l_linenumber", "rank"))


_SQL_HIST = ("rng AS (SELECT least(min(y), min(pred)) AS lo, greatest(max(y), max(pred)) AS hi, count(*) AS n "
             "FROM reg), "
             "hb AS (SELECT CAST(least(floor((y - lo) * (30.0 / (hi - lo))), 29) AS INTEGER) AS by_, "
             "CAST(least(floor((pred - lo) * (30.0 / (hi - lo))), 29) AS INTEGER) AS bp_ FROM reg, rng), "
             "ha AS (SELECT by_ AS bin, count(*) AS ca FROM hb GROUP BY 1), "
             "hp AS (SELECT bp_ AS bin, count(*) AS cb FROM hb GROUP BY 1), "
             "hist AS (SELECT s.bin, coalesce(ca, 0) / (n * ((hi - lo) / 30)) AS density_y, "
             "coalesce(cb, 0) / (n * ((hi - lo) / 30)) AS density_pred "
             "FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) s LEFT JOIN ha USING (bin) "
             "LEFT JOIN hp USING (bin), rng)")


#: The ten scalars of a validation step over ``reg(y, pred)``.
SQL_SCALARS = (f"{_SQL_RANKS}, {_SQL_HIST}, ks AS (SELECT sum(density_y + 1e-10) AS sp, sum(density_pred + 1e-10) AS sq FROM hist), "
               "pc AS (SELECT corr(y, pred) AS r, count(*) AS n FROM reg), sc AS (SELECT corr(ry, rp) AS r, count(*) AS n FROM rk), "
               "scalars AS (SELECT mse AS loss, 1 - sse / nullif(sst, 0) AS r2, mse, sqrt(mse) AS rmse, mae, (SELECT r FROM pc) AS pearson, "
               + sql_p_value("(SELECT r * sqrt((n - 2) / (1 - r * r)) FROM pc)", "(SELECT n FROM pc)") + " AS pearson_p, (SELECT r FROM sc) AS spearman, "
               + sql_p_value("(SELECT r * sqrt((n - 2) / (1 - r * r)) FROM sc)", "(SELECT n FROM sc)") + " AS spearman_p, "
               "(SELECT sum(((density_y + 1e-10) / sp) * ln(((density_y + 1e-10) / sp) / ((density_pred + 1e-10) / sq))) FROM hist, ks) AS kl "
               "FROM (SELECT sum((y - pred) * (y - pred)) AS sse, avg((y - pred) * (y - pred)) AS mse, avg(abs(y - pred)) AS mae, "
               "var_pop(y) * count(*) AS sst FROM reg))")


@register("shared_histogram", sql=f"WITH {SQL_REG}, {_SQL_HIST} SELECT * FROM hist")
def q_shared_histogram(spark: SparkSession, d: str) -> DataFrame:
    return finish(M.shared_histogram(_regression(spark, d), "y", "pred"))


@register("kl_divergence", sql=f"WITH {SQL_REG}, {_SQL_HIST}, "
          "s AS (SELECT sum(density_y + 1e-10) AS sp, sum(density_pred + 1e-10) AS sq FROM hist) "
          "SELECT sum(((density_y + 1e-10) / sp) * ln(((density_y + 1e-10) / sp) / ((density_pred + 1e-10) / sq))) "
          "AS kl FROM hist, s")
def q_kl_divergence(spark: SparkSession, d: str) -> DataFrame:
    h = M.shared_histogram(_regression(spark, d), "y", "pred")
    return finish(M.kl_divergence(h, "density_y", "density_pred"))
