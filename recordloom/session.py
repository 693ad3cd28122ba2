"""Session helpers: a local session for tests/bench and the shared checkpoint root."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on; applied to sessions we build ourselves.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Filter the parent table's scan with a bloom filter of the (selective)
    # active fact side before the join shuffles it.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Remove checkpoint files of the numbering once their data is unreferenced
    # (a long-running stream checkpoints once per micro-batch).
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "recordloom") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The session's setting always wins. Only when it is unset and the master is
    local (tests) do we pick a fresh scratch folder of our own; a cluster
    session without the setting is an error, never a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
        root = tempfile.mkdtemp(prefix="recordloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) sessions have no context; the conf is used
        return root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_root(spark: SparkSession) -> str:
    """The folder under the shared checkpoint folder that holds this library's written intermediate tables."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/recordloom"


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return "/".join([scratch_root(spark), *parts, uuid.uuid4().hex])


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    For a frame with several readers: computed once, and a lost executor
    costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
