"""Access to the driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


SCAN_PARTITIONS = "helixframe.scan.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily scan one table; filters and projections reach the parquet scan.

    Splits are the session's business (``spark.sql.files.maxPartitionBytes``).
    For inputs that cannot be split, such as a file of one row group, the
    caller may set ``helixframe.scan.partitions`` in the session: every scan is
    then dealt to that many partitions, whatever its size."""
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df
