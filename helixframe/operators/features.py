"""Table-level projections and filters over expression and sequence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.numeric import ACTIVE_THRESHOLD
from helixframe.functions.sequence import DINUCLEOTIDE_TABLES, dinucleotide_pairs


def expression_rows(events: DataFrame) -> DataFrame:
    """Binding of the expression table: intensity = 2 * value, dataset = type."""
    return events.select("event_id", F.col("event_type").alias("dataset"),
                         (F.col("value") * 2).alias("intensity"))


def active_filter(df: DataFrame, intensity: str = "intensity") -> DataFrame:
    """Rows with intensity >= 10 (a plain comparison, so it is pushed to
    the Parquet scan whenever ``intensity`` is a stored column)."""
    return df.where(F.col(intensity) >= ACTIVE_THRESHOLD)


def relative_error_filter(df: DataFrame, y: str, pred: str, tol: float = 0.1) -> DataFrame:
    """P5: |y - pred| / y < tol on the original scale; y = 0 is dropped
    (``try_divide`` gives null instead of an ANSI error) and a negative y
    passes, because the divisor is y itself."""
    return df.where(F.try_divide(F.abs(F.col(y) - F.col(pred)), F.col(y)) < tol)


def drop_unassigned(df: DataFrame, cls: str = "intensity_cls") -> DataFrame:
    """P6."""
    return df.where(F.col(cls) != -1)


def class_distribution(df: DataFrame, cls: str = "intensity_cls") -> DataFrame:
    """A5."""
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def distinct_class_count(df: DataFrame, cls: str = "intensity_cls") -> DataFrame:
    """One row; ``binary_path`` is true when exactly two labels exist."""
    n = F.count_distinct(cls)
    return df.agg(n.alias("n_classes"), (n == 2).alias("binary_path"))


def zscore_log1p(df: DataFrame, x: str, name: str = "z") -> DataFrame:
    """A4: (log1p(x) - mean) / population std, statistics over the whole
    table as a one-row aggregate joined back by broadcast."""
    stats = df.agg(F.avg(F.log1p(x)).alias("__m"), F.stddev_pop(F.log1p(x)).alias("__s"))
    return (df.crossJoin(F.broadcast(stats))
              .withColumn(name, (F.log1p(x) - F.col("__m")) / F.col("__s"))
              .drop("__m", "__s"))


def scan_by_dataset(df: DataFrame, name: str, dataset: str = "dataset") -> DataFrame:
    """One data set from a table of several.  When the table is written
    ``partitionBy(dataset)`` this equality becomes a partition filter."""
    return df.where(F.col(dataset) == name)


def dinucleotide_lookup(seqs: DataFrame, table: str = "CA_D", seq: str = "sequence") -> DataFrame:
    """J3 in join form: ``(row_id, pos, pair, value)`` for known pairs."""
    spark = seqs.sparkSession
    lookup = spark.createDataFrame([(k, float(v)) for k, v in DINUCLEOTIDE_TABLES[table].items()],
                                   "pair string, value double")
    pairs = seqs.select("row_id", F.posexplode(dinucleotide_pairs(seq)).alias("pos", "pair"))
    # 16 rows: a fixed-size table, safe to broadcast at any data size.
    return pairs.join(F.broadcast(lookup), "pair").select("row_id", "pos", "pair", "value")
