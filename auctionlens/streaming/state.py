"""Where streams keep their state, and in how many parts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: rows that one state partition is given at most, about
STATE_ROWS = 1_000_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """State partitions of a stream that has ``rows`` rows to take in: the
    session's shuffle partitions, or more, so that one holds STATE_ROWS at most."""
    now = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(now, -(-rows // STATE_ROWS))


@contextmanager
def state_on_disk(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """A stream started inside keeps its state in RocksDB, whose memory is bounded
    for all stores of an executor together, and not as maps in the heap, which
    grow with it. ``partitions`` holds from the query's first start. A checkpoint
    that began with other settings keeps its own."""
    conf = {PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}
    if partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield  # the stream runs on a clone of the session taken at its start
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
