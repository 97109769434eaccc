"""Session helpers.

The library never builds its own cluster settings on top of a session it is
handed: callers (the driver, a notebook, a scheduled job) own the session.
``local_session`` exists for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session used by this package should carry.  They are all
# correctness or plan-quality settings, not sizing: sizing (shuffle partitions,
# maxPartitionBytes, executor memory) belongs to the deployment.
_REQUIRED_CONF = {
    # Timestamps are compared with an UTC-naive oracle.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesces tiny shuffle partitions, splits skewed
    # join partitions and turns a sort-merge join into a broadcast join when
    # the measured (not estimated) size of one side is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash joins only where every measured partition of the build side is below
    # this size; all other joins sort and can spill.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Checkpoints written to cut lineage (global ranks) are removed once the
    # DataFrame that uses them is garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "helixframe") -> SparkSession:
    """A local session for tests and the bench (UI off, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
    )
    for k, v in _REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets ``spark.checkpoint.dir`` to a shared
    file system; we only read it.  Only a local master, where the driver and
    the tasks share one disk, gets a scratch folder of its own when it is
    unset; anywhere else that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Connect: the server owns the checkpoint folder)
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        if sc is None or not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="helixframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder;
    :func:`release_scratch` removes it."""
    path = os.path.join(ensure_checkpoint_dir(spark), name)
    _SCRATCH.append(path)
    return path


#: Of rows of megabytes each, what a task writes or reads at once: a row group is
#: closed when it is that large, looked at after every row, not only after 100.
WIDE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stored(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """``df`` written as Parquet to a new scratch folder and read again; ``wide``
    rows are megabytes each."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.options(compression="zstd", **(WIDE_ROWS if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders handed out so far, once the results that
    read them are written.  Returns how many there were."""
    jvm, n = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        p = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n
