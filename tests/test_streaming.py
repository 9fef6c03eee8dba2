"""Late data inside / beyond the watermark, duplicate telemetry, and
batch / stream equality on closed windows."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from auctionlens.operators.guardrail import guardrail_windows
from auctionlens.plans.session import ensure_checkpoint_dir
from auctionlens.streaming.guardrail import replay_guardrail, start_guardrail_stream

SCHEMA = "impression_id string, ts timestamp_ntz, sdk_version string, os_version string, ad_format string, billable boolean"


def _row(i, day, ver="8.1.0", billable=True):
    return (f"I{i}", datetime(2026, 5, day, 12), ver, "17.0", "rewarded_video", billable)


def test_watermark_late_rows_and_duplicates(spark):
    """Spark drops a row older than the previous batch's watermark; a row
    within the delay still reaches its open window."""
    run = f"{ensure_checkpoint_dir(spark)}/test_stream/{uuid.uuid4().hex}"
    files = [
        [_row(1, 1), _row(2, 1, "8.2.0", False), _row(2, 1, "8.2.0", False), _row(3, 3)],  # I2 duplicated
        [_row(4, 20)],  # watermark -> May 18 12:00 from the next batch on
        [_row(5, 3), _row(6, 19, "8.2.0")],  # within the delay of the previous watermark: kept
        [_row(8, 21)],  # May 3 window is evicted by now
        [_row(9, 3)],  # too late: dropped
        [_row(7, 30)],  # closes the May 19-21 windows
    ]
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{run}/src")
    q = start_guardrail_stream(
        spark, f"{run}/src", spark.read.parquet(f"{run}/src").schema, f"{run}/out", f"{run}/ck",
        window="1 day", watermark="2 days", min_n=1, tol=0.3, max_files_per_trigger=1,
    )
    q.awaitTermination()
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"])
    rows = spark.read.parquet(f"{run}/out").collect()
    out = {r["window_start"].day: r for r in rows}
    assert len(rows) == len(out)  # each window emitted once
    assert sorted(out) == [1, 3, 19, 20, 21]
    assert (out[1]["n_base"], out[1]["n_cand"]) == (1, 1)  # duplicate I2 counted once
    assert out[1]["alert"] is True  # conversion 0.0 vs 1.0
    assert out[3]["n_base"] == 2  # I3 + I5; the too-late I9 never arrives
    assert out[19]["n_cand"] == 1
    assert dropped == 1


def test_replay_returns_every_window_and_marks_closed_ones(spark, t001):
    from auctionlens.operators.guardrail import won_impressions

    won = won_impressions(t001)
    kw = dict(window="90 days", min_n=10, tol=0.3)
    stream = replay_guardrail(won, watermark="366 days", **kw)
    cut = won.agg(F.max("ts")).first()[0]
    batch = guardrail_windows(won, **kw)
    batch = batch.withColumn("closed", F.col("window_end") <= F.lit(cut) - F.expr("INTERVAL 366 DAYS"))
    key = lambda df: sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    assert key(stream) == key(batch)
    assert {r["closed"] for r in stream.select("closed").distinct().collect()} == {True, False}


def test_stream_static_enrichment_and_latency_percentiles(spark):
    """S01 + S05: a bare impression stream joined to the static requests
    table, with an approximate latency percentile in the streaming state."""
    run = f"{ensure_checkpoint_dir(spark)}/test_stream/{uuid.uuid4().hex}"
    requests = spark.createDataFrame(
        [("R1", "8.1.0", "17.0", "rewarded_video"), ("R2", "8.2.0", "17.0", "rewarded_video"),
         ("R3", "8.2.0", "17.0", "rewarded_video"), ("R9", "8.2.0", "18.0", "banner")],
        "request_id string, sdk_version string, os_version string, ad_format string",
    )
    schema = "impression_id string, request_id string, ts timestamp_ntz, billable boolean, render_latency_ms int"
    files = [
        [("I1", "R1", datetime(2026, 5, 1, 1), True, 400), ("I2", "R2", datetime(2026, 5, 1, 2), False, 2500),
         ("I3", "R3", datetime(2026, 5, 1, 3), False, 2600), ("IX", "R404", datetime(2026, 5, 1, 4), True, 1)],
        [("I9", "R9", datetime(2026, 5, 10), True, 300)],
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{run}/src")
    q = start_guardrail_stream(
        spark, f"{run}/src", spark.read.parquet(f"{run}/src").schema, f"{run}/out", f"{run}/ck",
        window="1 day", watermark="1 day", min_n=1, tol=0.3, requests=requests, latency_probs=(0.5,),
    )
    q.awaitTermination()
    (r,) = [x for x in spark.read.parquet(f"{run}/out").collect() if x["window_start"].day == 1]
    assert (r["n_base"], r["n_cand"]) == (1, 2)  # the impression of an unknown request is dropped by the join
    assert r["alert"] is True and r["p50_latency_cand"] == 2500


def test_foreach_batch_alert_table(spark):
    """The foreachBatch sink: windows and an alerts-only table, per batch id."""
    run = f"{ensure_checkpoint_dir(spark)}/test_stream/{uuid.uuid4().hex}"
    files = [
        [_row(1, 1), _row(2, 1, "8.2.0", False), _row(3, 2), _row(4, 2, "8.2.0", True)],
        [_row(5, 10)],
    ]
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{run}/src")
    q = start_guardrail_stream(
        spark, f"{run}/src", spark.read.parquet(f"{run}/src").schema, f"{run}/out", f"{run}/ck",
        window="1 day", watermark="2 days", min_n=1, tol=0.3, alerts_path=f"{run}/alerts",
    )
    q.awaitTermination()
    windows = spark.read.parquet(f"{run}/out").collect()
    alerts = spark.read.parquet(f"{run}/alerts").collect()
    assert sorted(r["window_start"].day for r in windows) == [1, 2]
    assert [(r["window_start"].day, r["alert"]) for r in alerts] == [(1, True)]


def test_stream_stream_join_with_time_bound(spark):
    """S01, both sides streaming: impressions meet their request within the
    delay bound; one arriving after the bound finds no partner."""
    from auctionlens.streaming.guardrail import guardrail_events, join_request_stream

    run = f"{ensure_checkpoint_dir(spark)}/test_stream/{uuid.uuid4().hex}"
    req_rows = [("R1", datetime(2026, 5, 1, 10), "8.1.0", "17.0", "rewarded_video"),
                ("R2", datetime(2026, 5, 1, 11), "8.2.0", "17.0", "rewarded_video"),
                ("R3", datetime(2026, 5, 1, 12), "8.2.0", "17.0", "rewarded_video")]
    imp_rows = [("I1", "R1", datetime(2026, 5, 1, 10, 0, 2), True),
                ("I2", "R2", datetime(2026, 5, 1, 11, 0, 3), False),
                ("I3", "R3", datetime(2026, 5, 1, 14), True)]  # two hours after its request: beyond the bound
    spark.createDataFrame(req_rows, "request_id string, request_ts timestamp_ntz, sdk_version string, os_version string, ad_format string") \
        .coalesce(1).write.parquet(f"{run}/req")
    spark.createDataFrame(imp_rows, "impression_id string, request_id string, ts timestamp_ntz, billable boolean") \
        .coalesce(1).write.parquet(f"{run}/imp")
    req = spark.readStream.schema(spark.read.parquet(f"{run}/req").schema).parquet(f"{run}/req")
    imp = guardrail_events(spark.readStream.schema(spark.read.parquet(f"{run}/imp").schema).parquet(f"{run}/imp"), "1 day")
    joined = join_request_stream(imp, req, max_delay="1 hour", watermark="1 day")
    q = joined.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/ck") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    out = {r["impression_id"]: r for r in spark.read.parquet(f"{run}/out").collect()}
    assert sorted(out) == ["I1", "I2"]
    assert out["I2"]["sdk_version"] == "8.2.0" and out["I1"]["ad_format"] == "rewarded_video"
