"""Session helpers: a tuned local session for tests/bench and the shared
checkpoint folder used to cut lineage of iterative operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "agora") -> SparkSession:
    """Local session used by tests and bench.  On a cluster, use the session
    the platform hands you; every operator only reads its settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("AGORA_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we only
    read it.  Where it is unset, a local master (tests) gets a fresh scratch
    folder; on a cluster this is an error, because executors could not read
    each other's checkpoints from a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="agora-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` to the reliable checkpoint folder (survives executor
    loss, unlike a local checkpoint) and return the truncated-lineage frame."""
    ensure_checkpoint_dir(df.sparkSession)
    from pyspark import StorageLevel

    # persisted first: writing a reliable checkpoint re-runs an uncached plan
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and reread
    it: like ``cut_lineage``, but compressed, without a copy in the executors'
    caches, and later plans read only the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nobody holds any
    more: it does so when the driver collects its garbage, which in a loop of
    small driver objects and large shuffles happens too seldom."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
