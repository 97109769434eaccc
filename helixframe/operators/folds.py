"""Folds, batches, paired samples and splits.

Shuffles are hash-ordered (md5 of seed and id): reproducible, independent of
partitioning and identical in any SQL engine, with the same fold-size
guarantees as a seeded permutation (membership differs from numpy's RNG).
Positions come from range-partitioned global numbering; per-class numbering
uses skew-safe running sums, since a class may hold half of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.tokens import hash_key
from helixframe.operators.ranking import global_row_number, running_sums

# --- fixed values (published defaults) ---
SEED = 42
N_FOLDS = 10
# --- end of fixed values ---


def _count(df: DataFrame, name: str = "__n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def kfold_sizes_fold(r: Column, n: Column, k: int) -> Column:
    """Fold of 0-based position r when n rows are cut into k contiguous
    folds whose first n mod k folds hold one extra row."""
    q = (n / k).cast("long")
    rem = n - q * k
    big = rem * (q + 1)
    return F.when(r < big, (r / (q + 1)).cast("long")) \
        .otherwise(rem + ((r - big) / q).cast("long")).cast("int")


def kfold_assign(df: DataFrame, id_col: str, k: int = N_FOLDS, seed: int = SEED,
                 name: str = "fold") -> DataFrame:
    """Hash-shuffled positions cut into k folds, sizes within 1."""
    h = df.withColumn("__hk", hash_key(F.lit(seed), F.col(id_col)))
    ranked = global_row_number(h, [F.col("__hk").asc(), F.col(id_col).asc()], "__rn")
    ranked = ranked.crossJoin(F.broadcast(_count(df)))  # one row
    return ranked.withColumn(name, kfold_sizes_fold(F.col("__rn") - 1, F.col("__n"), k)) \
        .drop("__hk", "__rn", "__n")


def stratified_kfold_assign(df: DataFrame, id_col: str, label: str, k: int = N_FOLDS, seed: int = SEED,
                            name: str = "fold") -> DataFrame:
    """Within each class, hash order; fold = (rank - 1) mod k, so every
    fold holds each class within one row of its share."""
    h = df.withColumn("__hk", hash_key(F.lit(seed), F.col(id_col)))
    r = running_sums(h, [label], [F.col("__hk").asc(), F.col(id_col).asc()], {"__rk": F.lit(1).cast("long")})
    return r.withColumn(name, ((F.col("__rk") - 1) % k).cast("int")).drop("__hk", "__rk")


def fold_split(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """train = fold != k, valid = fold == k (both kept, labelled)."""
    return df.withColumn("split", F.when(F.col(fold) == k, F.lit("valid")).otherwise(F.lit("train")))


def batch_index(df: DataFrame, order: list[Column], batch_size: int, name: str = "batch") -> DataFrame:
    """Consecutive fixed-size batches in the given order, last one short."""
    r = global_row_number(df, order, "__rn")
    return r.withColumn(name, ((F.col("__rn") - 1) / batch_size).cast("long")).drop("__rn")


def positions(df: DataFrame, id_col: str, name: str = "pos") -> DataFrame:
    """0-based position in id order (the reference's row index)."""
    return global_row_number(df, [F.col(id_col).asc()], "__rn").withColumn(name, F.col("__rn") - 1).drop("__rn")


def paired_rows(df: DataFrame, id_col: str) -> DataFrame:
    """Row i (real half) pairs with row i + n/2 (fake half), an equi-join
    on the shifted position.  ``(real_id, fake_id, pair)``."""
    p = positions(df.select(id_col), id_col).crossJoin(F.broadcast(_count(df)))
    half = (F.col("__n") / 2).cast("long")
    real = p.where(F.col("pos") < half).select(F.col(id_col).alias("real_id"), F.col("pos").alias("pair"),
                                               (F.col("pos") + half).alias("__fpos"))
    fake = p.where(F.col("pos") >= half).select(F.col(id_col).alias("fake_id"), F.col("pos").alias("__fpos"))
    return real.join(fake, "__fpos").select("real_id", "fake_id", "pair")


def paired_sample(df: DataFrame, id_col: str, m: Column | int, seed: int = SEED) -> DataFrame:
    """O3: m/2 real rows drawn without replacement (hash order) plus each
    one's fake partner; the whole table, unpaired rows included (their
    ``pair`` is null), when it is not larger than m.  Returns the sampled ids with ``label`` 1 (real) / 0 (fake) and ``pair``."""
    pairs = paired_rows(df, id_col)
    n = _count(df)
    mm = F.lit(m) if isinstance(m, int) else m
    h = pairs.withColumn("__hk", hash_key(F.lit(seed), F.col("real_id")))
    ranked = global_row_number(h, [F.col("__hk").asc(), F.col("real_id").asc()], "__rn") \
        .crossJoin(F.broadcast(n))
    keep = ranked.where((F.col("__n") > mm) & (F.col("__rn") <= (mm / 2).cast("long")))
    real = keep.select(F.col("real_id").alias(id_col), F.lit(1).alias("label"), "pair")
    fake = keep.select(F.col("fake_id").alias(id_col), F.lit(0).alias("label"), "pair")
    half = (F.col("__n") / 2).cast("long")
    at = F.col("pos")
    whole = positions(df.select(id_col), id_col).crossJoin(F.broadcast(n)).where(F.col("__n") <= mm).select(
        id_col, (at < half).cast("int").alias("label"), F.when(at < half, at).when(at < 2 * half, at - half).alias("pair"))
    return real.unionByName(fake).unionByName(whole)


def append_batches(batches: list[DataFrame], batch_col: str = "batch_id") -> DataFrame:
    """Row-wise append keeping duplicates, each batch tagged by order."""
    out = None
    for i, b in enumerate(batches):
        tagged = b.withColumn(batch_col, F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
