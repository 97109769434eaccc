"""Global order statistics without funnelling the table into one task.

``Window.orderBy(..)`` with no ``partitionBy`` plans to a single partition.
Everything here instead range-partitions on the order keys, works inside each
range, and adds a per-range offset taken from a table with one row per range
(bounded by the partition count, so broadcasting it is safe).

The range-partitioned table is used twice (per-range totals, and the rows
themselves).  Two independent range exchanges would each sample their own
bounds, so it is materialised once with an eager ``checkpoint()`` into the
shared ``spark.checkpoint.dir``: both branches then read the same partitions,
and a lost executor recomputes nothing upstream of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PID = "__hf_pid"
_MID = "__hf_mid"


def _parts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(1, int(conf))


def _ranged(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    from helixframe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based ``row_number`` in the total order ``order``.

    The order keys should be unique (add a tie-break column) so the numbering
    is reproducible when a task is re-run.  Cost: one range shuffle of the
    input plus a broadcast of ``num_partitions`` counts; no extra shuffle,
    because the position inside a range comes from
    ``monotonically_increasing_id`` on the sorted range.
    """
    n = _parts(df, num_partitions)
    ranged = (_ranged(df, order, n)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    counts = ranged.groupBy(_PID).agg(F.count(F.lit(1)).alias("__hf_n"))
    offsets = counts.select(
        _PID,
        F.coalesce(F.sum("__hf_n").over(
            Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("__hf_off"))
    local_ix = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (ranged.join(F.broadcast(offsets), _PID)
            .withColumn(name, F.col("__hf_off") + local_ix + 1)
            .drop(_PID, _MID, "__hf_off"))


def global_cumsum(df: DataFrame, order: Sequence[Column], weight: Column | str,
                  name: str = "cum_before", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over all rows strictly before each row.

    Used on pre-aggregated tables (distinct values with counts), so the
    second, in-range shuffle moves only distinct keys.
    """
    n = _parts(df, num_partitions)
    w = F.col(weight) if isinstance(weight, str) else weight
    ranged = _ranged(df.withColumn("__hf_w", w), order, n).withColumn(_PID, F.spark_partition_id())
    totals = ranged.groupBy(_PID).agg(F.sum("__hf_w").alias("__hf_t"))
    offsets = totals.select(
        _PID,
        F.coalesce(F.sum("__hf_t").over(
            Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("__hf_off"))
    within = Window.partitionBy(_PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("__hf_local", F.coalesce(F.sum("__hf_w").over(within), F.lit(0)))
            .join(F.broadcast(offsets), _PID)
            .withColumn(name, F.col("__hf_off") + F.col("__hf_local"))
            .drop(_PID, "__hf_w", "__hf_off", "__hf_local"))


def average_rank(df: DataFrame, value: str, name: str = "rank",
                 num_partitions: int | None = None) -> DataFrame:
    """1-based rank of ``value`` with ties given their average rank.

    Aggregates to distinct values first (map-side partial counts), ranks the
    distinct values with :func:`global_cumsum`, then joins the rank back on
    the value.  Nulls get a null rank.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__hf_c"))
    ranked = global_cumsum(distinct, [F.col(value).asc()], "__hf_c", "__hf_before", num_partitions)
    ranked = ranked.select(value, (F.col("__hf_before") + (F.col("__hf_c") + 1) / 2.0).alias(name))
    return df.join(ranked, value, "left")


def running_sums(df: DataFrame, partition: Sequence[str], order: Sequence[Column],
                 weights: dict[str, Column], num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of several weights per group, skew-safe.

    ``Window.partitionBy(group)`` would put a group that holds a third of
    the table into one task.  Here the table is range-partitioned on
    (group, order) so a hot group spans many ranges; each range computes its
    local running sums, and the totals of earlier ranges of the same group
    (a table with one row per (range, group)) are added back.
    """
    n = _parts(df, num_partitions)
    keys = [F.col(c) for c in partition]
    ranged = _ranged(df, [*keys, *order], n).withColumn(_PID, F.spark_partition_id())
    for name, w in weights.items():
        ranged = ranged.withColumn(f"__hf_w_{name}", w)
    local_w = Window.partitionBy(_PID, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                           Window.currentRow)
    for name in weights:
        ranged = ranged.withColumn(f"__hf_l_{name}", F.sum(f"__hf_w_{name}").over(local_w))
    totals = ranged.groupBy(_PID, *partition).agg(*[F.sum(f"__hf_w_{k}").alias(f"__hf_t_{k}") for k in weights])
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, *partition, *[
        F.coalesce(F.sum(f"__hf_t_{k}").over(before), F.lit(0)).alias(f"__hf_o_{k}") for k in weights])
    out = ranged.join(offsets, [_PID, *partition])
    for name in weights:
        out = out.withColumn(name, F.col(f"__hf_o_{name}") + F.col(f"__hf_l_{name}"))
    drop = [_PID] + [f"__hf_{p}_{k}" for k in weights for p in ("w", "l", "o")]
    return out.drop(*drop)
