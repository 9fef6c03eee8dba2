"""Session defaults and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are tuned for (none is needed for correct
# results): AQE on (runtime coalescing, skew-join splitting, broadcast
# conversion), UTC session zone (event-time windows align to UTC
# midnight), co-partitioned joins on a subset of keys, UI off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    # let a join on (request_id, x) use tables bucketed by request_id alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # streaming state on local disk, not the JVM heap: the dedup state holds
    # one key per impression inside the watermark delay
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, app: str = "auctionlens", conf: dict | None = None) -> SparkSession:
    """Local session for tests, tools and the bench; on a cluster use the
    session the platform provides and only ``ensure_checkpoint_dir``."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``; only when it is unset and the master
    is local (tests) a fresh scratch folder is created and registered. On a
    cluster a folder of one machine would be no use to the others, so an
    unset directory is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001  (no SparkContext handle, e.g. a remote session)
            d = None
    if d:
        return d.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="auctionlens-ckpt-", dir=os.environ.get("AUCTIONLENS_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001
        pass
    return d
