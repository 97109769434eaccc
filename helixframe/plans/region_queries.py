"""Region similarity (P10, J6, J7, A27-A33, S11, S12, C5) bound to ``embeddings``.

Each embedding's 64 values are 8 tokens x 8 dimensions; regions are
blank = tokens 0-1, up = 2, core = 3-4, down = 5, gene = 6-7.  A copy with
token p zeroed where (vec_id + p) mod 5 = 0 makes spans shrink (P10).
Accepted rows for C5: true and predicted intensities from the last two
values (normalised log scale), kept when the relative error is below 0.1.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import numeric as N
from helixframe.operators import features as X
from helixframe.operators import metrics as M
from helixframe.operators import regions as R
from helixframe.plans.metric_queries import SQL_REG, SQL_SCALARS, _regression
from helixframe.plans.registry import finish, register
from helixframe.session import scratch_path
from helixframe.sources.tables import table

# --- fixed values of the bindings ---
TOKENS, DIM = 8, 8
REGION_SLICES = {"blank": (0, 2), "up": (2, 1), "core": (3, 2), "down": (5, 1), "gene": (6, 2)}
ZERO_MOD = 5
# --- end of fixed values ---


def _matrix(emb: F.Column, zero_with: F.Column | None) -> F.Column:
    def tok(i: F.Column) -> F.Column:
        v = F.transform(F.slice(emb, i * DIM + 1, DIM), lambda x: x.cast("double"))
        if zero_with is None:
            return v
        return F.when((zero_with + i) % ZERO_MOD == 0, F.array_repeat(F.lit(0.0), DIM)).otherwise(v)
    return F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), tok)


def _mats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", _matrix(F.col("embedding"), None).alias("m"),
                    _matrix(F.col("embedding"), F.col("vec_id")).alias("z"), "embedding")


def _regions(df: DataFrame) -> dict[str, F.Column]:
    return {r: R.region_span(F.slice("z", s + 1, n)) for r, (s, n) in REGION_SLICES.items()}


_SQL_MATS = (f"mats AS (SELECT vec_id, embedding, "
             f"list_transform(range(0, {TOKENS}), lambda i: list_transform(embedding[i * {DIM} + 1:i * {DIM} + {DIM}], "
             f"lambda x: CAST(x AS DOUBLE))) AS m, "
             f"list_transform(range(0, {TOKENS}), lambda i: CASE WHEN (vec_id + i) % {ZERO_MOD} = 0 "
             f"THEN list_transform(range({DIM}), lambda k: CAST(0 AS DOUBLE)) ELSE list_transform("
             f"embedding[i * {DIM} + 1:i * {DIM} + {DIM}], lambda x: CAST(x AS DOUBLE)) END) AS z FROM embeddings)")


def _sql_span(mat: str) -> str:
    nz = f"list_transform({mat}, lambda v: list_max(v) <> 0)"
    first = f"list_position({nz}, true)"
    last = f"(len({nz}) - list_position(list_reverse({nz}), true) + 1)"
    return f"CASE WHEN {first} > 0 THEN ({mat})[{first}:{last}] ELSE [] END"


_SQL_REGIONS = ("regs AS (SELECT vec_id, embedding, "
                + ", ".join(f"{_sql_span(f'z[{s + 1}:{s + n}]')} AS {r}" for r, (s, n) in REGION_SLICES.items())
                + " FROM mats)")
_SQL_PAIRS = ("rp AS (" + " UNION ALL ".join(
    f"SELECT vec_id, '{a}_{b}' AS pair, {a} AS a, {b} AS b FROM regs" for a, b in R.REGION_PAIRS) + ")")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    mats = _mats(spark, d)
    return R.region_pairs(mats, _regions(mats), ["vec_id"])


def _profile_pairs(spark: SparkSession, d: str, profile) -> DataFrame:
    """Pairs of region profiles, each profile computed once per region (a
    region is in four pairs); empty regions are in no pair."""
    mats = _mats(spark, d)
    spans = mats.select("vec_id", *[c.alias(r) for r, c in _regions(mats).items()])
    prof = {r: F.when(F.size(r) > 0, profile(r)) for r in R.REGIONS}
    return R.region_pairs(spans, prof, ["vec_id"]).where(F.col("a").isNotNull() & F.col("b").isNotNull())


@register("region_span", sql=f"WITH {_SQL_MATS} SELECT vec_id, "
          f"list_position(list_transform(z, lambda v: list_max(v) <> 0), true) AS first_pos, {_sql_span('z')} AS span "
          "FROM mats")
def q_region_span(spark: SparkSession, d: str) -> DataFrame:
    """P10 on the zeroed 8-token matrix: leading/trailing zero rows go,
    interior ones stay."""
    mats = _mats(spark, d)
    nz = F.transform("z", lambda v: F.array_max(v) != 0)
    return mats.select("vec_id", F.array_position(nz, True).cast("int").alias("first_pos"),
                       R.region_span("z").alias("span"))


@register("region_pair_join", sql=f"WITH {_SQL_MATS}, {_SQL_REGIONS}, {_SQL_PAIRS} "
          "SELECT vec_id, pair, CAST(len(a) AS INTEGER) AS a_len, CAST(len(b) AS INTEGER) AS b_len FROM rp")
def q_region_pair_join(spark: SparkSession, d: str) -> DataFrame:
    """The ten region pairs of every sequence."""
    return _pairs(spark, d).select("vec_id", "pair", F.size("a").alias("a_len"), F.size("b").alias("b_len"))


@register("token_pair_cross", sql=f"WITH {_SQL_MATS}, {_SQL_REGIONS}, {_SQL_PAIRS} "
          "SELECT vec_id, pair, CAST(len(a) * len(b) AS INTEGER) AS n_pairs, "
          "list_sum(list_transform(a, lambda u: list_sum(list_transform(b, lambda v: list_dot_product(u, v))))) "
          "/ (len(a) * len(b)) AS mean_dot FROM rp WHERE len(a) > 0 AND len(b) > 0")
def q_token_pair_cross(spark: SparkSession, d: str) -> DataFrame:
    """The n x m token pairs of two regions, summarised (count and mean
    dot product) without forming them; the oracle forms them all."""
    p = _pairs(spark, d).where((F.size("a") > 0) & (F.size("b") > 0))
    return finish(p.select("vec_id", "pair", (F.size("a") * F.size("b")).alias("n_pairs"),
                           R.mean_pairwise_dot("a", "b").alias("mean_dot")))


_SQL_COS = ("list_sum(list_transform(a, lambda u: list_sum(list_transform(b, lambda v: CASE WHEN "
            "sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) = 0 THEN 0 ELSE list_dot_product(u, v) / "
            "(sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))) END)))) / (len(a) * len(b))")
_SQL_EUC = ("-(list_sum(list_transform(a, lambda u: list_sum(list_transform(b, lambda v: "
            "sqrt(list_sum(list_transform(list_zip(u, v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))))))) "
            "/ (len(a) * len(b)))")
_SQL_PEA = ("list_sum(list_transform(a, lambda u: list_sum(list_transform(b, lambda v: "
            "(list_sum(list_transform(list_zip(u, v), lambda t: (t[1] - list_avg(u)) * (t[2] - list_avg(v)))) / len(u))"
            " / (sqrt(list_sum(list_transform(u, lambda x: (x - list_avg(u)) * (x - list_avg(u)))) / (len(u) - 1)) * "
            "sqrt(list_sum(list_transform(v, lambda x: (x - list_avg(v)) * (x - list_avg(v)))) / (len(v) - 1))))))) "
            "/ (len(a) * len(b))")


@register("region_cosine", sql=f"WITH {_SQL_MATS}, {_SQL_REGIONS}, {_SQL_PAIRS} "
          f"SELECT vec_id, pair, {_SQL_COS} AS cosine FROM rp WHERE len(a) > 0 AND len(b) > 0")
def q_region_cosine(spark: SparkSession, d: str) -> DataFrame:
    return finish(_profile_pairs(spark, d, R.cosine_profile).select("vec_id", "pair", R.dot(F.col("a"), F.col("b")).alias("cosine")))


@register("region_euclidean", sql=f"WITH {_SQL_MATS}, {_SQL_REGIONS}, {_SQL_PAIRS} "
          f"SELECT vec_id, pair, {_SQL_EUC} AS euclidean FROM rp WHERE len(a) > 0 AND len(b) > 0")
def q_region_euclidean(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).where((F.size("a") > 0) & (F.size("b") > 0))
    return finish(p.select("vec_id", "pair", R.region_euclidean("a", "b").alias("euclidean")))


@register("region_pearson", sql=f"WITH {_SQL_MATS}, {_SQL_REGIONS}, {_SQL_PAIRS} "
          f"SELECT vec_id, pair, {_SQL_PEA} AS pearson FROM rp WHERE len(a) > 0 AND len(b) > 0")
def q_region_pearson(spark: SparkSession, d: str) -> DataFrame:
    p = _profile_pairs(spark, d, R.pearson_profile)
    return finish(p.select("vec_id", "pair", R.pearson_from_profiles("a", "b").alias("pearson")))


@register("region_pearson_corrected", sql=f"WITH {_SQL_MATS}, {_SQL_REGIONS}, {_SQL_PAIRS} "
          f"SELECT vec_id, pair, {_SQL_PEA.replace('/ len(u))', '/ (len(u) - 1))')} AS pearson FROM rp WHERE len(a) > 0 AND len(b) > 0")
def q_region_pearson_corrected(spark: SparkSession, d: str) -> DataFrame:
    """A29 with ``corrected``: both moments divide by d - 1."""
    p = _profile_pairs(spark, d, R.pearson_profile)
    return finish(p.select("vec_id", "pair", R.pearson_from_profiles("a", "b", corrected=True).alias("pearson")))


_SQL_DIST = ("sqrt(list_sum(list_transform(list_zip(a[{i}], b[{j}]), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))")


@register("region_dtw", sql=f"WITH RECURSIVE {_SQL_MATS}, {_SQL_REGIONS}, {_SQL_PAIRS}, "
          f"paths AS (SELECT vec_id, pair, a, b, 1 AS i, 1 AS j, {_SQL_DIST.format(i='1', j='1')} AS cost FROM rp "
          "WHERE len(a) > 0 AND len(b) > 0 UNION ALL "
          f"SELECT vec_id, pair, a, b, i + di, j + dj, cost + {_SQL_DIST.format(i='i + di', j='j + dj')} "
          "FROM paths, (VALUES (0, 1), (1, 0), (1, 1)) AS step(di, dj) WHERE i + di <= len(a) AND j + dj <= len(b)) "
          "SELECT vec_id, pair, min(cost) AS dtw FROM paths WHERE i = len(a) AND j = len(b) GROUP BY vec_id, pair")
def q_region_dtw(spark: SparkSession, d: str) -> DataFrame:
    """DTW cost per region pair, a per-row dynamic program in an
    Arrow-batched pandas UDF; the twin walks every warping path."""
    p = _pairs(spark, d).where((F.size("a") > 0) & (F.size("b") > 0))
    return finish(p.select("vec_id", "pair", R.region_dtw_udf("a", "b").alias("dtw")))


_SQL_MI = ("mv AS (SELECT vec_id, pair, x, y FROM (SELECT vec_id, pair, unnest(list_zip(flatten(a), flatten(b))) AS t "
           "FROM rp) , LATERAL (SELECT t[1] AS x, t[2] AS y) WHERE x IS NOT NULL AND y IS NOT NULL), "
           "mr AS (SELECT vec_id, pair, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n "
           "FROM mv GROUP BY ALL), "
           "mb AS (SELECT vec_id, pair, n, CAST(CASE WHEN x1 - x0 > 0 THEN least(floor((x - x0) * (30.0 / (x1 - x0))), 29) "
           "ELSE 0 END AS INTEGER) AS bx, CAST(CASE WHEN y1 - y0 > 0 THEN least(floor((y - y0) * (30.0 / (y1 - y0))), 29) "
           "ELSE 0 END AS INTEGER) AS by_ FROM mv JOIN mr USING (vec_id, pair)), "
           "mj AS (SELECT vec_id, pair, bx, by_, count(*) AS c, any_value(n) AS n FROM mb GROUP BY ALL), "
           "mx AS (SELECT vec_id, pair, bx, sum(c) AS cx FROM mj GROUP BY ALL), "
           "my AS (SELECT vec_id, pair, by_, sum(c) AS cy FROM mj GROUP BY ALL)")


@register("region_mutual_info", sql=f"WITH {_SQL_MATS}, {_SQL_REGIONS}, {_SQL_PAIRS}, {_SQL_MI} "
          "SELECT vec_id, pair, sum((c / n) * ln((c / n) / ((cx / n) * (cy / n)))) AS mutual_info "
          "FROM mj JOIN mx USING (vec_id, pair, bx) JOIN my USING (vec_id, pair, by_) GROUP BY vec_id, pair")
def q_region_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    """A31 in the textbook joint form on position-paired values."""
    return finish(R.mutual_information(_pairs(spark, d), ["vec_id", "pair"]))


@register("mean_pool", sql=f"WITH {_SQL_MATS} SELECT vec_id, list_transform(range(1, {DIM + 1}), "
          "lambda k: list_avg(list_transform(m, lambda v: v[k]))) AS pooled FROM mats")
def q_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """A32 over the 8 token vectors."""
    return finish(_mats(spark, d).select("vec_id", R.mean_pool("m").alias("pooled")))


@register("cls_pool", sql=f"WITH {_SQL_MATS} SELECT vec_id, m[1] AS cls FROM mats")
def q_cls_pool(spark: SparkSession, d: str) -> DataFrame:
    """The first token's vector."""
    return finish(_mats(spark, d).select("vec_id", R.cls_pool("m").alias("cls")))


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    mats = _mats(spark, d)
    y_n = F.element_at("embedding", 64).cast("double") * 8.0
    p_n = y_n + F.element_at("embedding", 63).cast("double") * 0.5
    withi = mats.select("vec_id", "z", N.expm1_destandardise(y_n).alias("intensity_y"),
                        N.expm1_destandardise(p_n).alias("intensity_pred"))
    return X.relative_error_filter(withi, "intensity_y", "intensity_pred")


def region_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Accepted rows (P5) -> region spans (P10) -> ten pairs (J6) ->
    Pearson (A29), laid out one wide row per sequence (S11)."""
    acc = _accepted(spark, d)
    regs = acc.select("vec_id", "intensity_y", "intensity_pred",
                      *[c.alias(r) for r, c in _regions(acc).items()])  # each span computed once
    prof = regs.select("vec_id", "intensity_y", "intensity_pred",
                       *[R.pearson_profile(r).alias(r) for r in R.REGIONS])  # one profile per region
    sims = [R.pearson_from_profiles(a, b).alias(f"sim_{a}_{b}") for a, b in R.REGION_PAIRS]
    return prof.select(F.col("vec_id").alias("id"), "intensity_y", "intensity_pred", *sims)


_SQL_C5 = (f"WITH {_SQL_MATS}, acc0 AS (SELECT vec_id, z, "
           f"exp(CAST(embedding[64] AS DOUBLE) * 8.0 * {N.INTENSITY_LOG1P_STD!r} + {N.INTENSITY_LOG1P_MEAN!r}) - 1 "
           "AS intensity_y, "
           f"exp((CAST(embedding[64] AS DOUBLE) * 8.0 + CAST(embedding[63] AS DOUBLE) * 0.5) * {N.INTENSITY_LOG1P_STD!r}"
           f" + {N.INTENSITY_LOG1P_MEAN!r}) - 1 AS intensity_pred FROM mats), "
           "acc AS (SELECT * FROM acc0 WHERE abs(intensity_y - intensity_pred) / nullif(intensity_y, 0) < 0.1), "
           "regs AS (SELECT vec_id, intensity_y, intensity_pred, "
           + ", ".join(f"{_sql_span(f'z[{s + 1}:{s + n}]')} AS {r}" for r, (s, n) in REGION_SLICES.items())
           + " FROM acc) SELECT vec_id AS id, intensity_y, intensity_pred, "
           + ", ".join(f"(SELECT {_SQL_PEA} FROM (SELECT {a} AS a, {b} AS b)) AS sim_{a}_{b}"
                       for a, b in R.REGION_PAIRS) + " FROM regs")

register("region_similarity", sql=_SQL_C5)(lambda spark, d: finish(region_similarity(spark, d)))


@register("sink_region_similarity", sql=_SQL_C5)
def q_sink_region_similarity(spark: SparkSession, d: str) -> DataFrame:
    """C5 written as one headered CSV row per sequence under the shared
    checkpoint folder, read back with its schema."""
    path = scratch_path(spark, f"region_similarity-{uuid.uuid4().hex}")
    out = region_similarity(spark, d)
    out.write.mode("overwrite").option("header", True).csv(path)
    return finish(spark.read.option("header", True).schema(out.schema).csv(path))


_SCALARS = ("loss", "r2", "mse", "rmse", "mae", "pearson", "pearson_p", "spearman", "spearman_p", "kl")


@register("metrics_long", sql=f"WITH {SQL_REG}, {SQL_SCALARS}, m AS (SELECT 0 AS step, * FROM scalars) "
          f"UNPIVOT m ON {', '.join(_SCALARS)} INTO NAME metric VALUE value")
def q_metrics_long(spark: SparkSession, d: str) -> DataFrame:
    """The ten scalars of a validation step, long form (step, metric, value)."""
    m = M.regression_report(_regression(spark, d), "y", "pred").withColumn("step", F.lit(0))
    return finish(m.unpivot(["step"], list(_SCALARS), "metric", "value"))
