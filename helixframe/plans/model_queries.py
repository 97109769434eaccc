"""Models, user functions and evaluation composites (2.9 M1-M8, S13, 2.11 X1-X3, C2-C4).

The ML queries run on the C7 feature table (documents: first half real,
second half fake, 400 dinucleotide energies, stratified folds); fold 0 is
the validation fold.  C2-C4 score the mean-pooled embedding tokens with
fixed linear heads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import numeric as N
from helixframe.functions import tokens as TF
from helixframe.functions.udf import batch_score_udf, grouped_pair_apply, linear_model, mean_cosine, pair_udf
from helixframe.operators import metrics as M
from helixframe.operators import ml as ML
from helixframe.operators import model_selection as MS
from helixframe.operators import regions as R
from helixframe.operators import tokens as T
from helixframe.operators.boosting import first_split_gains
from helixframe.plans import region_queries as RQ
from helixframe.plans import token_queries as TQ
from helixframe.plans.fold_queries import _SQL_C7, feature_table
from helixframe.plans.metric_queries import HEAD_BIAS, HEAD_WEIGHTS, SQL_SCALARS, _W_SQL
from helixframe.plans.registry import finish, register
from helixframe.session import scratch_path, stored
from helixframe.sources.tables import table

# --- fixed values of the bindings ---
C2_W = [((j % 5) - 2) * 10.0 for j in range(8)]
C2_B = 0.05
C3_W = [((j % 3) - 1) * 8.0 for j in range(8)]
C3_B = 0.0
C4_W = [[(((j + k) % 5) - 2) * 10.0 for j in range(8)] for k in range(4)]
# --- end of fixed values ---


#: Boosted trees stop when the loss on a watched fold has not improved for so many trees.
PATIENCE = 2
BOOSTED = {"patience": PATIENCE}


def _features(spark: SparkSession, d: str) -> DataFrame:
    """The feature table, written once: a fit reads it many times."""
    return stored(feature_table(spark, d), "features")


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ft = _features(spark, d)
    return ft.where(F.col("fold") != 0), ft.where(F.col("fold") == 0)


@register("standard_scale", sql=f"WITH {_SQL_C7}, "
          "ex AS (SELECT unnest(range(1, 401)) AS dim, unnest(features) AS x FROM sk WHERE fold <> 0), "
          "st AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM ex GROUP BY dim), "
          "vec AS (SELECT list(mu ORDER BY dim) AS mus, list(sd ORDER BY dim) AS sds FROM st) "
          "SELECT row_id, list_transform(range(1, 401), lambda i: (features[i] - mus[i]) / "
          "(CASE WHEN sds[i] = 0 THEN 1.0 ELSE sds[i] END)) AS scaled FROM sk, vec")
def q_standard_scale(spark: SparkSession, d: str) -> DataFrame:
    """M1: population-std scaling fitted on the training folds."""
    ft = feature_table(spark, d)
    return finish(ML.standard_scale(ft, F.col("fold") != 0).select("row_id", "scaled"))


def _scored(fitted: MS.Fitted, rows: DataFrame) -> DataFrame:
    out = fitted.predict(rows.select("row_id", "label", "features"))
    return finish(out.select("row_id", "label", F.rint("p_pos").cast("int").alias("prediction"), "p_pos"))


@register("fit_logistic")
def q_fit_logistic(spark: SparkSession, d: str) -> DataFrame:
    """M2: logistic regression with the tuned C on the raw features (scaling
    would change the meaning of C; only M5 scales)."""
    train, valid = _split(spark, d)
    return _scored(MS.fit("logistic", train), valid)


@register("fit_random_forest")
def q_fit_random_forest(spark: SparkSession, d: str) -> DataFrame:
    """M3: random forest with the tuned sizes (depth capped at 30)."""
    train, valid = _split(spark, d)
    return _scored(MS.fit("random_forest", train), valid)


@register("fit_boosted_trees")
def q_fit_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """M4: second-order boosted trees with the tuned values, gamma and lambda
    among them; fold 1 of the training folds decides when to stop."""
    train, valid = _split(spark, d)
    return _scored(MS.fit("boosted_trees", train.where(F.col("fold") != 1), BOOSTED, train.where(F.col("fold") == 1)), valid)


_GAIN = ("(gl * gl / (hl + 0.9346) + (g - gl) * (g - gl) / (h - hl + 0.9346) - g * g / (h + 0.9346))")


@register("boosted_first_split", sql=f"WITH {_SQL_C7}, "
          "ex AS (SELECT unnest(range(0, 400)) AS feature, unnest(features) AS x, label FROM sk WHERE fold <> 0), "
          "cnt AS (SELECT feature, x, sum(CAST(0.5 AS DOUBLE) - label) AS g, sum(CAST(0.25 AS DOUBLE)) AS h FROM ex GROUP BY ALL), "
          "cum AS (SELECT feature, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS g, "
          "sum(h) OVER (PARTITION BY feature) AS h FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY x)), "
          f"ok AS (SELECT feature, x, {_GAIN} AS gain FROM cum WHERE hl >= 5 AND h - hl >= 5), "
          "best AS (SELECT feature, x, gain, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, x) AS k FROM ok) "
          "SELECT CAST(f.feature AS INTEGER) AS feature, b.x AS threshold, b.gain FROM (SELECT DISTINCT feature FROM cnt) f "
          "LEFT JOIN best b ON b.feature = f.feature AND b.k = 1")
def q_boosted_first_split(spark: SparkSession, d: str) -> DataFrame:
    """M4: the gain that each feature's best split of the root has by the
    sums of gradients and Hessians, all training rows taken."""
    return finish(first_split_gains(_split(spark, d)[0]))


@register("fit_rbf_svm")
def q_fit_rbf_svm(spark: SparkSession, d: str) -> DataFrame:
    """M5: random Fourier features for the RBF kernel, a linear SVM, and
    probabilities calibrated on held-out margins."""
    train, valid = _split(spark, d)
    return _scored(MS.fit("rbf_svm", train), valid)


#: Trials by kind on the first rung (published: 1000, 100, 100, 100).
TRIALS = {"boosted_trees": 3, "logistic": 3, "rbf_svm": 3, "random_forest": 3}
AT_ONCE = 8   # fits under way at once


@register("param_search")
def q_param_search(spark: SparkSession, d: str) -> DataFrame:
    """M6: trials of all four kinds from the published ranges by successive
    halving on the persisted fold 0; every trial's loss is a row."""
    path = scratch_path(spark, f"search-{uuid.uuid4().hex}")
    return finish(MS.param_search(_features(spark, d), TRIALS, path, rungs=2, fixed={"boosted_trees": BOOSTED}, parallelism=AT_ONCE))


N_FOLDS = 10


def _out_of_fold(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    path = scratch_path(spark, f"folds-{uuid.uuid4().hex}")
    kinds = {kind: BOOSTED if kind == "boosted_trees" else {} for kind in MS.KINDS}
    return MS.cross_validate(_features(spark, d), kinds, list(range(N_FOLDS)), path, AT_ONCE), path


@register("cross_validate")
def q_cross_validate(spark: SparkSession, d: str) -> DataFrame:
    """M7: four kinds over the ten persisted folds; seven metrics per model and
    fold from the out-of-fold predictions, and their means (fold null)."""
    per = MS.fold_metrics(_out_of_fold(spark, d)[0], ["model", "fold"])
    mean = MS.mean_metrics(per, ["model"]).withColumn("fold", F.lit(None).cast("int"))
    return finish(per.unionByName(mean))


@register("positive_probability")
def q_positive_probability(spark: SparkSession, d: str) -> DataFrame:
    """M8: P(label = 1) from the class-probability vector."""
    train, valid = _split(spark, d)
    return _scored(MS.fit("logistic", train), valid).select("row_id", "p_pos")


@register("model_reload")
def q_model_reload(spark: SparkSession, d: str) -> DataFrame:
    """The models of all folds are saved, loaded back by fold number, and
    each scores its fold; ``p_saved`` is the score before."""
    ft, path = _features(spark, d), scratch_path(spark, f"models-{uuid.uuid4().hex}")
    folds = list(range(N_FOLDS))
    saved = MS.cross_validate(ft, {"logistic": {}}, folds, path, keep_models=True)
    out = None
    for k in folds:
        part = MS.load_fold(spark, path, "logistic", k).predict(ft.where(F.col("fold") == k)).select("row_id", "fold", "p_pos")
        out = part if out is None else out.unionByName(part)
    return finish(out.join(saved.select("row_id", F.col("p_pos").alias("p_saved")), "row_id"))


# ---------------------------------------------------------------- X1-X3
@register("batch_score_udf", sql=f"SELECT vec_id, {HEAD_BIAS!r} + list_sum(list_transform(range(1, 65), "
          f"lambda i: CAST(embedding[i] AS DOUBLE) * ({_W_SQL})[i])) AS score FROM embeddings")
def q_batch_score_udf(spark: SparkSession, d: str) -> DataFrame:
    """A user model (here linear) scored in batches of 128 rows."""
    e = table(spark, d, "embeddings")
    score = batch_score_udf(linear_model(HEAD_WEIGHTS, HEAD_BIAS), width=64, batch_size=128)
    return finish(e.select("vec_id", score(F.transform("embedding", lambda x: x.cast("double"))).alias("score")))


@register("grouped_pair_udf", sql=f"WITH {RQ._SQL_MATS}, {RQ._SQL_REGIONS}, {RQ._SQL_PAIRS} "
          f"SELECT vec_id, pair, {RQ._SQL_COS} AS value FROM rp WHERE len(a) > 0 AND len(b) > 0")
def q_grouped_pair_udf(spark: SparkSession, d: str) -> DataFrame:
    """A user function of two matrices (mean pairwise cosine in numpy)."""
    p = RQ._pairs(spark, d).where((F.size("a") > 0) & (F.size("b") > 0))
    return finish(p.select("vec_id", "pair", pair_udf(mean_cosine)("a", "b").alias("value")))


@register("grouped_pair_apply", sql=f"WITH {RQ._SQL_MATS}, {RQ._SQL_REGIONS}, {RQ._SQL_PAIRS} "
          f"SELECT vec_id, pair, {RQ._SQL_COS} AS value FROM rp WHERE len(a) > 0 AND len(b) > 0")
def q_grouped_pair_apply(spark: SparkSession, d: str) -> DataFrame:
    """X2, the grouped form: the matrices arrive as one row per vector."""
    p = RQ._pairs(spark, d).where((F.size("a") > 0) & (F.size("b") > 0))
    side = lambda c: p.select("vec_id", "pair", F.lit(c).alias("side"), F.posexplode(c).alias("pos", "vector"))
    return finish(grouped_pair_apply(side("a").unionByName(side("b")), ["vec_id", "pair"], mean_cosine))


@register("sampler_strategy", sql=f"WITH {TQ.SQL_TOKENS}, {TQ._SQL_SCHED}, {TQ._SQL_KEEP}, "
          f"ww AS (SELECT n.row_id, n.pos, n.token_id, n.noised = {TF.MASK_ID} AS masked, "
          "NOT regexp_matches(w.word, '^[A-Z]') AS is_continuation FROM noised2 n JOIN words w USING (row_id, pos)), "
          "ww2 AS (SELECT *, SUM(CASE WHEN is_continuation THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY pos "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS word_ix FROM ww), "
          "ww3 AS (SELECT *, first_value(masked) OVER (PARTITION BY row_id, word_ix ORDER BY pos "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ww_masked FROM ww2) "
          f"SELECT row_id, pos, token_id, CASE WHEN ww_masked THEN {TF.MASK_ID} ELSE token_id END AS noised FROM ww3")
def q_sampler_strategy(spark: SparkSession, d: str) -> DataFrame:
    """The whole-word corruption strategy chosen by name."""
    keep = TQ._keep(spark, d).withColumnRenamed("word_continues", "is_continuation")
    out = T.corrupt_with(keep, "whole_word", TQ.SEED)
    return out.select("row_id", "pos", "token_id", "noised")


# ------------------------------------------------------------ composites
def _pooled_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    mats = e.select("vec_id", "label", RQ._matrix(F.col("embedding"), None).alias("m"), "embedding")
    return mats.select("vec_id", "label", "embedding", R.mean_pool("m").alias("pool"))


_SQL_POOL = (f"{RQ._SQL_MATS}, pooled AS (SELECT m.vec_id, e.label, m.embedding, list_transform(range(1, 9), "
             "lambda k: list_avg(list_transform(m.m, lambda v: v[k]))) AS pool FROM mats m JOIN embeddings e "
             "USING (vec_id))")


def _sql_head(w: list[float], b: float, vec: str = "pool") -> str:
    ws = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in w) + "]"
    return f"({b!r} + list_sum(list_transform(range(1, {len(w) + 1}), lambda i: {vec}[i] * ({ws})[i])))"


@register("authenticity_eval", sql=f"WITH {_SQL_POOL}, "
          f"bin AS (SELECT vec_id, label % 2 AS y, {_sql_head(C2_W, C2_B)} AS z FROM pooled), "
          "binp AS (SELECT *, CAST(round_even(1.0 / (1.0 + exp(-z)), 0) AS INTEGER) AS pred FROM bin), "
          "rc AS (SELECT z AS threshold, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, "
          "sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS neg FROM bin GROUP BY z), "
          "rt AS (SELECT sum(pos) AS P, sum(neg) AS N FROM rc), "
          "rcum AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND "
          "1 PRECEDING), 0) AS cp_before FROM rc), "
          "cnt AS (SELECT CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, "
          "CAST(sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, "
          "CAST(sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, "
          "CAST(sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM binp) "
          "SELECT (SELECT avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) FROM bin) AS bce, "
          "coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, "
          "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, "
          "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, "
          "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc, "
          "(SELECT sum((CAST(neg AS DOUBLE) / N) * (2 * cp_before + pos) / (2 * P)) FROM rcum, rt) AS auc FROM cnt")
def authenticity_eval(spark: SparkSession, d: str) -> DataFrame:
    """Mean-pool the token vectors (A32), score with a linear head (F14),
    report BCE loss (A8), the binary metrics (A12) and AUC (A14)."""
    p = _pooled_scores(spark, d).select((F.col("label") % 2).alias("y"),
                                        N.linear_head("pool", C2_W, C2_B).alias("z"))
    bce = M.bce_with_logits(p, "z", "y")
    bm = M.binary_metrics(p.withColumn("pred", N.sigmoid_class("z")), "y", "pred") \
        .select("accuracy", "precision", "recall", "f1", "mcc")
    return finish(bce.crossJoin(bm).crossJoin(M.auc(p, "y", "z")))


_SQL_C3 = (f"{_SQL_POOL}, "
           f"ex AS (SELECT vec_id, exp(CAST(embedding[64] AS DOUBLE) * 8.0 * {N.INTENSITY_LOG1P_STD!r} + "
           f"{N.INTENSITY_LOG1P_MEAN!r}) - 1 AS intensity, {_sql_head(C3_W, C3_B)} AS pred FROM pooled), "
           f"reg AS (SELECT (ln(1 + intensity) - {N.INTENSITY_LOG1P_MEAN!r}) / {N.INTENSITY_LOG1P_STD!r} AS y, pred "
           "FROM ex)")


@register("expression_eval", sql=f"WITH {_SQL_C3}, {SQL_SCALARS} SELECT r2, mse, rmse, mae, pearson, pearson_p, spearman, spearman_p, kl FROM scalars")
def expression_eval(spark: SparkSession, d: str) -> DataFrame:
    """Intensities log-standardised (F9), scored by a linear head on the
    pooled vector, then R2 / MSE / RMSE / MAE (A18), Pearson (A19),
    Spearman (A20), both with their p-values, and histogram KL (A21, A22)."""
    p = _pooled_scores(spark, d)
    intensity = N.expm1_destandardise(F.element_at("embedding", 64).cast("double") * 8.0)
    reg = p.select(N.log1p_standardise(intensity).alias("y"), N.linear_head("pool", C3_W, C3_B).alias("pred"))
    return finish(M.regression_report(reg, "y", "pred").drop("loss"))


@register("expression_class_eval", sql=f"WITH {_SQL_POOL}, "
          f"ex AS (SELECT vec_id, exp(CAST(embedding[64] AS DOUBLE) * 8.0 * {N.INTENSITY_LOG1P_STD!r} + "
          f"{N.INTENSITY_LOG1P_MEAN!r}) - 1 AS intensity, [" + ", ".join(_sql_head(w, 0.0) for w in C4_W) + "] AS z "
          "FROM pooled), "
          "cls AS (SELECT z, CASE WHEN intensity IS NULL OR isnan(intensity) THEN -1 WHEN intensity < 10 THEN 0 "
          "WHEN intensity < 100 THEN 1 WHEN intensity < 500 THEN 2 ELSE 3 END AS y, "
          "CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred FROM ex), "
          "cm AS (SELECT y AS y_true, pred AS y_pred, count(*) AS n FROM cls GROUP BY ALL), "
          "tr AS (SELECT y_true AS k, sum(n) AS t FROM cm GROUP BY 1), "
          "pr AS (SELECT y_pred AS k, sum(n) AS pp FROM cm GROUP BY 1), "
          "dg AS (SELECT y_true AS k, n AS tp FROM cm WHERE y_true = y_pred), "
          "per AS (SELECT coalesce(tr.k, pr.k) AS k, CAST(coalesce(t, 0) AS DOUBLE) AS t, "
          "CAST(coalesce(pp, 0) AS DOUBLE) AS pp FROM tr FULL JOIN pr ON tr.k = pr.k), "
          "per2 AS (SELECT per.*, CAST(coalesce(dg.tp, 0) AS DOUBLE) AS tp FROM per LEFT JOIN dg USING (k)) "
          "SELECT (SELECT avg(list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) - z[y + 1])"
          " FROM cls) AS cross_entropy, sum(tp) / sum(t) AS accuracy, "
          "avg(coalesce(tp / nullif(pp, 0), 0)) AS macro_precision, avg(coalesce(tp / nullif(t, 0), 0)) AS macro_recall, "
          "avg(coalesce(2 * tp / nullif(t + pp, 0), 0)) AS macro_f1, "
          "coalesce((sum(tp) * sum(t) - sum(t * pp)) / nullif(sqrt((sum(t) * sum(t) - sum(pp * pp)) * "
          "(sum(t) * sum(t) - sum(t * t))), 0), 0) AS mcc FROM per2")
def expression_class_eval(spark: SparkSession, d: str) -> DataFrame:
    """C4: 4-class bins of the intensity (P11), four linear heads (F14),
    cross entropy (A9), argmax (O2), macro metrics (A16) and MCC (A17)."""
    p = _pooled_scores(spark, d)
    intensity = N.expm1_destandardise(F.element_at("embedding", 64).cast("double") * 8.0)
    z = F.array(*[N.linear_head("pool", w, 0.0) for w in C4_W])
    cls = p.select(N.bin_intensity_4(intensity).alias("y"), z.alias("z")).withColumn("pred", N.argmax("z"))
    ce = M.softmax_cross_entropy(cls, "z", "y")
    mac = M.multiclass_macro(cls, "y", "pred")
    mcc = M.multiclass_mcc(cls, "y", "pred")
    return finish(ce.crossJoin(mac).crossJoin(mcc))
