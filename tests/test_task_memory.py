"""What one task holds stays the same as the tables grow: buckets, shuffles,
state and sorts follow the rows."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta

from auctionlens.operators import alerts, quality
from auctionlens.plans.inspect import exchanges
from auctionlens.sources import tables
from auctionlens.streaming import state
from auctionlens.streaming.guardrail import start_guardrail_stream, start_matching

HEAP_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _auction(micro, n=40):
    req = [dict(request_id=f"r{i}") for i in range(n)]
    bids = [dict(bid_id=f"b{i}", request_id=f"r{i}", is_winner=1, cleared_price=4.0) for i in range(n)]
    imps = [dict(impression_id=f"b{i}", request_id=f"r{i}") for i in range(n)]
    return micro(requests=req, bids=bids, impressions=imps)


def test_buckets_and_shuffles_follow_the_rows(spark, micro, tmp_path, monkeypatch):
    base = spark.sparkContext.defaultParallelism
    assert tables.buckets_for_rows(spark, 600_000) == base
    assert tables.buckets_for_rows(spark, 216_000_000) == 256  # 6 GB of source files
    for name, df in _auction(micro).as_dict().items():
        df.write.parquet(f"{tmp_path}/in/{name}")
    monkeypatch.setattr(tables, "BUCKET_ROWS", 2)
    prefix = f"al_{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(INITIAL, None)
    try:
        tables.store_tables(tables.load_reference_tables(spark, f"{tmp_path}/in"), f"{tmp_path}/out", prefix)
        assert int(spark.conf.get(INITIAL)) == 32
        tables.size_shuffles(spark, 4)
        assert int(spark.conf.get(INITIAL)) == 32  # never lowered
    finally:
        spark.conf.unset(INITIAL) if before is None else spark.conf.set(INITIAL, before)
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {prefix}_bids").collect()}
    assert described["Num Buckets"] == "32"


def test_tasks_that_compare_bids_follow_their_number(spark, micro, monkeypatch):
    monkeypatch.setattr(quality, "TASK_BIDS", 4)
    t = _auction(micro)
    checks = quality.contract_check(t)
    assert "hashpartitioning(bid_id, 10), REPARTITION_BY_NUM" in re.sub(r"#\d+L?", "", checks._jdf.queryExecution().executedPlan().toString())
    assert any(e.startswith("hashpartitioning(bid_id, 10") for e in exchanges(checks))
    assert {r.violations for r in checks.collect() if r.check_name == "pk_duplicate"} == {0}


def test_alert_events_sort_the_windows_once(spark):
    at = datetime(2026, 5, 1)
    rows = [("17", "banner", at + timedelta(days=i), x) for i, x in enumerate([5000, 100, -9000, 4000, 10, 20])]
    scores = spark.createDataFrame(rows, "os_version string, ad_format string, window_end timestamp_ntz, x bigint")
    events = alerts.events_of(scores, open_at=3000, quiet="48 hours", escalate_after="36 hours")
    found = [(r.alert, r.event, r["at"], r.score) for r in sorted(events.collect(), key=lambda r: (r["at"], r.event))]
    day = lambda n: at + timedelta(days=n)
    assert found == [
        (1, "open", day(0), 5000), (1, "update", day(1), 5100), (1, "escalate", day(1.5), None), (1, "recovered", day(2), 0),
        (2, "open", day(3), 4000), (2, "update", day(4), 4010), (2, "escalate", day(4.5), None), (2, "update", day(5), 4030), (2, "silent", day(7), None),
    ]
    plan = events._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("Sort [") <= 4


def test_streams_keep_their_state_on_disk(spark, tmp_path):
    """Whatever the session's store is, and in as many parts as the rows ask for."""
    at = datetime(2026, 5, 1)
    events = spark.createDataFrame([(f"i{i}", f"r{i}", at, True, "8.1.0", "17", "banner") for i in range(9)], "impression_id string, request_id string, ts timestamp_ntz, billable boolean, sdk_version string, os_version string, ad_format string")
    events.write.parquet(f"{tmp_path}/events")
    events.selectExpr("request_id", "ts request_ts", "sdk_version", "os_version", "ad_format").write.parquet(f"{tmp_path}/requests")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")
    before = spark.conf.get(state.PROVIDER)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(state.PROVIDER, HEAP_STORE)
    try:
        q1 = start_guardrail_stream(spark, f"{tmp_path}/events", events.schema, f"{tmp_path}/g", f"{tmp_path}/gc", state_partitions=3)
        q2 = start_matching(read("events").drop("sdk_version", "os_version", "ad_format"), read("requests"), f"{tmp_path}/m", f"{tmp_path}/u", f"{tmp_path}/mc", state_partitions=3)
        for q in (q1, q2):
            q.awaitTermination()
            assert q.exception() is None
            for op in q.recentProgress[0].stateOperators:
                assert any(k.startswith("rocksdb") for k in op.customMetrics), q
                assert op.numShufflePartitions == 3
        assert spark.conf.get(state.PROVIDER) == HEAP_STORE and spark.conf.get("spark.sql.shuffle.partitions") == parts
    finally:
        spark.conf.set(state.PROVIDER, before)
    assert state.partitions_for(spark, 10) == int(parts)
    assert state.partitions_for(spark, 100_000_000) == 100
