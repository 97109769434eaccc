"""Folds, batches, samples and unions.

Bindings: ``orders`` keyed by o_orderkey for folds and pairs (first half of
the key order = real rows, second half = their fake partners);
``documents`` x ``labels`` for stratified folds; ``events`` for batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import numeric as N
from helixframe.functions.sequence import energy_features
from helixframe.operators import folds as FO
from helixframe.operators import metrics as M
from helixframe.plans import bindings as B
from helixframe.plans.feature_queries import _SQL_PAD, _sql_energy
from helixframe.plans.metric_queries import SQL_BIN, _binary_pred
from helixframe.plans.registry import finish, register
from helixframe.sources.tables import table

# --- fixed values of the bindings ---
SEED = FO.SEED
K = FO.N_FOLDS
BATCH = 128
# --- end of fixed values ---


def _hk(col: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {SEED}, {col})), 1, 8)) AS BIGINT)"


def _sql_kfold(src: str, id_col: str, k: int = K) -> str:
    return (f"kf0 AS (SELECT {id_col} AS row_id, row_number() OVER (ORDER BY {_hk(id_col)}, {id_col}) - 1 AS r, "
            f"count(*) OVER () AS n FROM {src}), "
            f"kf AS (SELECT row_id, CAST(CASE WHEN r < (n % {k}) * (n // {k} + 1) THEN r // (n // {k} + 1) "
            f"ELSE (n % {k}) + (r - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS INTEGER) AS fold FROM kf0)")


def _sql_strat(src: str, id_col: str, label: str, k: int = K) -> str:
    return (f"sk AS (SELECT *, CAST((row_number() OVER (PARTITION BY {label} ORDER BY {_hk(id_col)}, {id_col}) - 1) "
            f"% {k} AS INTEGER) AS fold FROM {src})")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))


@register("kfold_assign", sql=f"WITH {_sql_kfold('orders', 'o_orderkey')} SELECT row_id, fold FROM kf")
def q_kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    """10 folds over every order, sizes within one."""
    return FO.kfold_assign(_orders(spark, d), "row_id")


@register("fold_split", sql=f"WITH {_sql_kfold('orders', 'o_orderkey')} SELECT row_id, fold, "
          "CASE WHEN fold = 0 THEN 'valid' ELSE 'train' END AS split FROM kf")
def q_fold_split(spark: SparkSession, d: str) -> DataFrame:
    """P3 for fold 0."""
    return FO.fold_split(FO.kfold_assign(_orders(spark, d), "row_id"), 0)


@register("train_valid_union", sql=f"WITH {_sql_kfold('orders', 'o_orderkey')} "
          "SELECT row_id, fold, 'train' AS split FROM kf WHERE fold <> 0 "
          "UNION ALL SELECT row_id, fold, 'valid' AS split FROM kf WHERE fold = 0")
def q_train_valid_union(spark: SparkSession, d: str) -> DataFrame:
    """Both splits of fold 0 stacked again (UNION ALL), so statistics see all rows."""
    f = FO.kfold_assign(_orders(spark, d), "row_id")
    train = f.where(F.col("fold") != 0).withColumn("split", F.lit("train"))
    valid = f.where(F.col("fold") == 0).withColumn("split", F.lit("valid"))
    return train.unionByName(valid)


_SQL_LABELED = "lab AS (SELECT doc_id, quality AS label FROM labels)"


@register("stratified_kfold_assign", sql=f"WITH {_SQL_LABELED}, {_sql_strat('lab', 'doc_id', 'label')} "
          "SELECT doc_id, label, fold FROM sk")
def q_stratified_kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    """10 folds per quality class."""
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return FO.stratified_kfold_assign(lab, "doc_id", "label").select("doc_id", "label", "fold")


@register("batch_index", sql=f"SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // {BATCH} AS BIGINT) "
          "AS batch FROM events")
def q_batch_index(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 128 in row order."""
    ev = table(spark, d, "events").select("event_id")
    return FO.batch_index(ev, [F.col("event_id").asc()], BATCH)


_SQL_POS = ("pos0 AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, "
            "count(*) OVER () AS n FROM orders), "
            "pairs AS (SELECT a.id AS real_id, b.id AS fake_id, a.pos AS pair FROM pos0 a JOIN pos0 b "
            "ON b.pos = a.pos + a.n // 2 WHERE a.pos < a.n // 2)")


@register("paired_rows", sql=f"WITH {_SQL_POS} SELECT real_id, fake_id, pair FROM pairs")
def q_paired_rows(spark: SparkSession, d: str) -> DataFrame:
    """Order i of the first half with order i + n/2."""
    return FO.paired_rows(_orders(spark, d), "row_id")


def _m(n_col: str = "n") -> str:
    return f"2 * ({n_col} // 3)"


@register("paired_sample", sql=f"WITH {_SQL_POS}, "
          "ps AS (SELECT p.*, row_number() OVER (ORDER BY " + _hk("real_id") + ", real_id) AS rn, "
          "(SELECT count(*) FROM orders) AS n FROM pairs p), "
          f"keep AS (SELECT * FROM ps WHERE n <= {_m()} OR rn <= ({_m()}) // 2) "
          "SELECT real_id AS row_id, 1 AS label, pair FROM keep UNION ALL SELECT fake_id, 0, pair FROM keep")
def q_paired_sample(spark: SparkSession, d: str) -> DataFrame:
    """O3 with m = 2 * floor(n / 3): a third of the real rows and their partners."""
    o = _orders(spark, d)
    n = o.count()  # one number; the sample size is a parameter of the operator
    return FO.paired_sample(o, "row_id", 2 * (n // 3)).select("row_id", "label", "pair")


@register("append_batches", sql="SELECT doc_id AS id, 1.0 / (1.0 + exp(-(CAST(n_chars - 1500 AS DOUBLE) / 1000.0))) "
          "AS prob, 0 AS batch_id FROM documents UNION ALL SELECT item_id, 1.0 / (1.0 + exp(-(CAST(length(text) - 150 "
          "AS DOUBLE) / 100.0))), 1 FROM benchmark")
def q_append_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two scored batches appended, duplicates kept, tagged by batch."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), N.sigmoid((F.col("n_chars") - 1500) / 1000.0).alias("prob"))
    bench = table(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), N.sigmoid((F.length("text") - 150) / 100.0).alias("prob"))
    return finish(FO.append_batches([docs, bench]))


@register("fold_mean_metrics", sql=f"WITH {SQL_BIN}, {_sql_strat('binp', 'doc_id', 'y')}, "
          "pf AS (SELECT fold, CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, "
          "CAST(sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, "
          "CAST(sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, "
          "CAST(sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM sk GROUP BY fold) "
          "SELECT avg(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0)) AS accuracy, "
          "avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS precision, avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS recall, "
          "avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1, "
          "avg(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)) "
          "AS mcc FROM pf")
def q_fold_mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Binary metrics per stratified fold, then their unweighted mean."""
    b = FO.stratified_kfold_assign(_binary_pred(spark, d), "doc_id", "y")
    per = M.binary_metrics(b, "y", "pred", by=["fold"])
    return finish(M.fold_mean(per, ["accuracy", "precision", "recall", "f1", "mcc"]))


_SQL_C7 = (f"{B.SQL_DNA}, "
           "pos0 AS (SELECT row_id AS id, row_number() OVER (ORDER BY row_id) - 1 AS pos, count(*) OVER () AS n "
           "FROM dna), "
           "pairs AS (SELECT a.id AS real_id, b.id AS fake_id, a.pos AS pair FROM pos0 a JOIN pos0 b "
           "ON b.pos = a.pos + a.n // 2 WHERE a.pos < a.n // 2), "
           "ps AS (SELECT p.*, row_number() OVER (ORDER BY " + _hk("real_id") + ", real_id) AS rn, "
           "(SELECT count(*) FROM dna) AS n FROM pairs p), "
           f"keep AS (SELECT * FROM ps WHERE n <= {_m()} OR rn <= ({_m()}) // 2), "
           "samp AS (SELECT real_id AS row_id, 1 AS label FROM keep UNION ALL SELECT fake_id, 0 FROM keep), "
           f"feat AS (SELECT s.row_id, s.label, ({_SQL_PAD})[1:400] AS features FROM samp s JOIN "
           f"(SELECT row_id, {_sql_energy('CA_D')} AS v FROM dna) e USING (row_id)), "
           f"{_sql_strat('feat', 'row_id', 'label')}")


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """Paired sample of the documents (first half real, second half
    fake) -> 400 dinucleotide energies -> stratified folds."""
    dna = B.dna_sequences(spark, d)
    n = dna.count()
    samp = FO.paired_sample(dna.select("row_id"), "row_id", 2 * (n // 3)).select("row_id", "label")
    feats = samp.join(dna, "row_id").select("row_id", "label", energy_features("sequence").alias("features"))
    return FO.stratified_kfold_assign(feats, "row_id", "label").select("row_id", "label", "fold", "features")


register("feature_table", sql=f"WITH {_SQL_C7} SELECT row_id, label, fold, features FROM sk")(
    lambda spark, d: finish(feature_table(spark, d)))
