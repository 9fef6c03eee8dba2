"""Storing and loading the six tables.

Facts are written as parquet tables bucketed and sorted by ``request_id``
(the key every fact joins on), so joins and per-request aggregates between
them read co-located buckets instead of shuffling the largest tables.
Dimensions are written unbucketed. Writes use ``mode('overwrite')``, so a
reload is idempotent (the reference drops and recreates its tables).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from auctionlens.plans.inspect import hash_partitioned_on
from auctionlens.plans.session import ensure_checkpoint_dir
from auctionlens.plans.stats import leaf_bytes
from auctionlens.sources.schema import SCHEMAS, TIME_PARTITION, AdTables, period_start

FACTS = ("ad_requests", "bids", "impressions", "sdk_events")
DIMENSIONS = ("buyers", "publishers")
BUCKET_KEY = "request_id"
READY_MARKER = "_tables_ready"


#: size that the bucket files of one period should have
TARGET_FILE_BYTES = 256 * 1024 * 1024


def default_buckets(spark: SparkSession) -> int:
    """The cluster's task parallelism (all executor cores), so a scan of a
    bucketed table keeps every core busy."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001  (no SparkContext handle)
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def choose_buckets(spark: SparkSession, source_bytes: int, periods: int = 1) -> int:
    """One bucket count for all facts (co-location needs the same count).

    Every period folder holds one file per bucket, so the count follows the
    bytes of one period: about TARGET_FILE_BYTES a file, as a power of two and
    without an upper limit, and at least the cluster's parallelism. A query
    over p periods reads p such files in each task; choose the period (month,
    year) so that the usual range is a few of them."""
    n = max(1, -(-source_bytes // (TARGET_FILE_BYTES * max(1, periods))))
    return max(default_buckets(spark), 1 << (n - 1).bit_length())


#: rows of the largest fact that one bucket holds at most, over all periods
BUCKET_ROWS = 1_000_000


def buckets_for_rows(spark: SparkSession, rows: int) -> int:
    """The bucket count by the rows of the largest fact, as ``choose_buckets`` by
    its bytes: a query over all periods reads a whole bucket in one task, and so
    does the build, which sorts it several times. With at most BUCKET_ROWS rows
    a bucket the memory of such a task stays the same as the tables grow."""
    n = max(1, -(-rows // BUCKET_ROWS))
    return max(default_buckets(spark), 1 << (n - 1).bit_length())


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Lets shuffles on other keys than the bucket's follow the rows, too: the
    number of partitions that adaptive execution starts from, before it joins
    small ones. A session that has more already keeps its own."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = max(1, -(-rows // BUCKET_ROWS))
    if n > now:
        spark.conf.set(name, str(1 << (n - 1).bit_length()))


def count_periods(requests: DataFrame, unit: str | None) -> int:
    """Number of periods that the requests span (1 without time partitions)."""
    if not unit:
        return 1
    return max(1, requests.select(period_start(F.col("request_ts"), unit).alias("p")).agg(F.count_distinct("p")).first()[0])


def co_partition(spark: SparkSession) -> None:
    """Let joins on (request_id, x) use tables bucketed by request_id alone.
    Set on whatever session loads the tables: the plans rely on it."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def _table_name(prefix: str, name: str) -> str:
    return f"{prefix}_{name}"


def write_tables(
    tables: Mapping[str, DataFrame],
    root: str,
    prefix: str,
    buckets: int | None = None,
    prepartitioned: tuple[str, ...] = (),
    time_partition: str | None = None,
) -> None:
    """Write each table under ``{root}/{name}`` and register it in the session
    catalog as ``{prefix}_{name}``; facts bucketed by ``request_id``.

    A fact named in ``prepartitioned`` is expected to be hash-partitioned
    on request_id into ``buckets`` partitions already (by the window or
    bucketed join that produced it). The physical plan is checked, and only
    then is the write done without another shuffle (one file per bucket).
    Otherwise, e.g. when a dimension was too large to broadcast and the
    join re-partitioned the rows, it is repartitioned first. With
    ``time_partition`` facts are also partitioned by that column (one
    folder per period, buckets inside).
    """
    spark = next(iter(tables.values())).sparkSession
    n = buckets or default_buckets(spark)
    for name, df in tables.items():
        w = df
        if name in FACTS:
            aligned = name in prepartitioned and hash_partitioned_on(df, BUCKET_KEY, n)
            src = df if aligned else df.repartition(n, BUCKET_KEY)
            w = src.write.bucketBy(n, BUCKET_KEY).sortBy(BUCKET_KEY)
            if time_partition:
                w = w.partitionBy(time_partition)
        else:
            w = df.hint("rebalance").write  # as many files as its size asks for
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(prefix, name)}")
        w.mode("overwrite").format("parquet").option("path", f"{root}/{name}").saveAsTable(_table_name(prefix, name))


def mark_ready(spark: SparkSession, root: str, buckets: int, folder: str = ".") -> None:
    """Written last: publishes the table set in ``{root}/{folder}``. Each build
    writes a folder of its own, so concurrent builders never see each other's
    files and nothing is renamed; of several complete sets the last marker
    wins, and any of them is right."""
    spark.createDataFrame([(buckets, folder)], "buckets int, folder string").coalesce(1).write.mode("overwrite").json(f"{root}/{READY_MARKER}")


def tables_ready(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Bucket count and folder of the published table set under ``root``, else None."""
    try:
        row = spark.read.schema("buckets int, folder string").json(f"{root}/{READY_MARKER}").first()
    except AnalysisException:
        return None
    return (int(row["buckets"]), row["folder"]) if row else None


def new_folder() -> str:
    return f"set-{uuid.uuid4().hex[:8]}"


def register_tables(
    spark: SparkSession, root: str, prefix: str, names: list[str], buckets: int, time_partition: str | None = None
) -> None:
    """Register stored tables in this session's catalog (their bucket and
    partition spec is metadata, so it is restated here)."""
    for name in names:
        tn = _table_name(prefix, name)
        if spark.catalog.tableExists(tn):
            continue
        schema = spark.read.parquet(f"{root}/{name}").schema
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        fact = name in FACTS
        parted = f"PARTITIONED BY ({time_partition})" if fact and time_partition else ""
        clustered = f"CLUSTERED BY ({BUCKET_KEY}) SORTED BY ({BUCKET_KEY}) INTO {buckets} BUCKETS" if fact else ""
        spark.sql(f"CREATE TABLE {tn} ({cols}) USING parquet {parted} {clustered} LOCATION '{root}/{name}'")
        if parted:
            spark.catalog.recoverPartitions(tn)


def stored_tables(
    spark: SparkSession,
    root: str,
    prefix: str,
    columns: Mapping[str, list[str]] | None = None,
    winning_bid_in_request: bool = False,
    time_partition: str | None = None,
    time_unit: str = "year",
) -> AdTables:
    """The six tables read from the catalog, optionally projected to the
    public columns (helper columns stay on disk and are pruned at the scan)."""
    co_partition(spark)
    out = {}
    for name in (*FACTS, *DIMENSIONS):
        df = spark.table(_table_name(prefix, name))
        cols = (columns or {}).get(name)
        if cols and time_partition and name in FACTS:
            cols = [*cols, time_partition]
        out[name] = df.select(*cols) if cols else df
    return AdTables(**out, winning_bid_in_request=winning_bid_in_request, time_partition=time_partition, time_unit=time_unit)


def load_reference_tables(spark: SparkSession, root: str) -> AdTables:
    """Reference-shaped parquet (one folder per table under ``root``) read with
    the fixed schemas, so types never depend on inference."""
    return AdTables(**{name: spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}") for name in SCHEMAS})


def _summary(spark: SparkSession, path: str) -> tuple[int, int, int] | None:
    """(bytes, files, modification time) of a path through Spark's own file
    system for its scheme; None if it does not exist. No file list is made."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    s = fs.getContentSummary(p)
    return int(s.getLength()), int(s.getFileCount()), int(fs.getFileStatus(p).getModificationTime())


def source_bytes(paths: list[str], spark: SparkSession) -> int:
    """Total size of source files or folders on any file system Spark reads."""
    return sum(s[0] for s in (_summary(spark, p) for p in paths) if s)


def source_signature(paths: list[str], spark: SparkSession) -> str:
    """Signature of the sources: size, file count and modification time of
    each path, which change when the data is rewritten."""
    h = hashlib.sha1()
    for p in sorted(paths):
        h.update(f"{p}:{_summary(spark, p)}".encode())
    return h.hexdigest()[:12]


def views_root(spark: SparkSession, key: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/auctionlens_tables/{key}"


def store_tables(
    t: AdTables,
    root: str,
    prefix: str | None = None,
    buckets: int | None = None,
    time_unit: str | None = "month",
    winning_bid_in_request: bool = False,
) -> AdTables:
    """Lay any six tables out for scale under ``root`` and return them stored.

    Facts are bucketed by request_id; with ``time_unit`` every fact also
    carries ``request_period`` (from its request, attached by a
    bucket-aligned join to the stored requests) and is partitioned by it.
    ``winning_bid_in_request`` may be declared once ``contract_check``
    shows ``rule_winning_bid_other_request`` = 0.
    """
    spark = t.ad_requests.sparkSession
    co_partition(spark)
    size = max(leaf_bytes(getattr(t, name)) for name in FACTS)
    rows = max(getattr(t, name).count() for name in FACTS)
    n = buckets or max(choose_buckets(spark, size, count_periods(t.ad_requests, time_unit)), buckets_for_rows(spark, rows))
    size_shuffles(spark, rows)
    prefix = prefix or "al_" + hashlib.sha1(root.encode()).hexdigest()[:12]
    part = TIME_PARTITION if time_unit else None
    requests = t.ad_requests
    if part:
        requests = requests.withColumn(part, period_start(F.col("request_ts"), time_unit))
    write_tables({"ad_requests": requests, "buyers": t.buyers, "publishers": t.publishers}, root, prefix, n, time_partition=part)
    periods = spark.table(_table_name(prefix, "ad_requests")).select("request_id", part) if part else None
    for name in ("bids", "impressions", "sdk_events"):
        df = getattr(t, name)
        if periods is not None:
            df = df.join(periods, "request_id", "left")
        write_tables({name: df}, root, prefix, n, time_partition=part)
    mark_ready(spark, root, n)
    return stored_tables(
        spark, root, prefix, winning_bid_in_request=winning_bid_in_request, time_partition=part, time_unit=time_unit or "year",
    )
