"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(app: str = "whofor", cores: str = "*", shuffle: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and benches. On a cluster the submitter owns these."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
             .config("spark.driver.memory", memory)
             # Recording a call site per column expression costs more than building the plan.
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.codegen.maxFields", "200")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SPLIT_BYTES, SPLITS_PER_CORE, LARGE_PER_CORE = 4 << 20, 8, 1 << 30


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores before CPU-bound work.

    A table of one small file is one task, and a larger one of few row groups is few: minutes of
    work a task where every row costs a millisecond. By the optimizer's own estimate rows are moved
    to tasks of about ``SPLIT_BYTES``, a few a core at most; a table so large that its read splits
    come to several a core is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * LARGE_PER_CORE:
        return df
    return df.repartition(min(cores * SPLITS_PER_CORE, max(cores, -(-size // SPLIT_BYTES))))


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; a session that sets its own bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2 ** 31 - 1)).rstrip("bB") or 0) >= 2 ** 31 - 1:
        spark.conf.set(key, str(8 << 20))


def small_methods(spark: SparkSession) -> None:
    """Keep generated methods to a size the JVM compiles (8,000 bytes); larger ones it interprets.

    A session that sets its own limit keeps it.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) >= 65535:
        spark.conf.set(key, "8000")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only in local mode (tests).

    Executors of a cluster do not share a local folder, so there one must be named.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: replicated storage, so a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
