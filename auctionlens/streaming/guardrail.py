"""The win-to-billable guardrail as a Structured Streaming job.

Source: a folder of won-impression files (one row per impression with its
event time, SDK version, cohort keys and billable flag), read with
``readStream``. Event time is bounded by a watermark, duplicate telemetry
is dropped within the watermark, and the per-window conditional aggregate
of D11 (``guardrail_windows``) runs as a stateful streaming aggregation.
Append mode emits each window once, when the watermark closes it, into a
parquet sink; the sink and its checkpoint live under the shared
``spark.checkpoint.dir``, so a restarted query resumes exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auctionlens.operators.funnel import BASE, CAND
from auctionlens.operators.guardrail import GUARDRAIL_KEYS, guardrail_windows
from auctionlens.plans.session import ensure_checkpoint_dir
from auctionlens.streaming.state import partitions_for, state_on_disk


def guardrail_events(
    stream: DataFrame, watermark: str = "2 days", ts_col: str = "ts", id_col: str = "impression_id", dedup: bool = True
) -> DataFrame:
    """Event-time column as TIMESTAMP (watermarks reject timestamp_ntz), the
    watermark, and duplicate removal on the impression id within it.

    State sizes: the window aggregate keeps one row per open window x
    cohort, which is small; the dedup keeps one key per impression seen
    within the watermark delay, which grows with traffic. That is why the
    streams are started with the RocksDB state store (disk, not heap). Use
    ``dedup=False`` for a source that already delivers exactly once.
    """
    ev = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    return ev.dropDuplicatesWithinWatermark([id_col]) if dedup else ev


def enrich_with_requests(
    events: DataFrame,
    requests: DataFrame,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    since: str | None = None,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Attach version and cohort keys from the requests table to a bare
    impression stream (a stateless stream-static join on request_id).

    Use it when the telemetry does not carry the cohort attributes itself;
    each micro-batch joins only its own rows, so state does not grow. ``since``
    bounds the requests that every trigger reads (pushed to their scan). With
    ``keep_unmatched`` impressions whose request is not stored yet stay, with
    NULL version and keys, and can be counted or sent to a side table.
    """
    req = requests if since is None else requests.filter(F.col("request_ts") >= F.lit(since).cast("timestamp_ntz"))
    return events.join(req.select("request_id", "sdk_version", *keys), "request_id", "left" if keep_unmatched else "inner")


def join_request_stream(
    events: DataFrame,
    requests: DataFrame,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    max_delay: str = "1 hour",
    watermark: str = "2 days",
    ts_col: str = "ts",
    keep_unmatched: bool = False,
) -> DataFrame:
    """S01 with both sides streaming: impressions (already watermarked on
    ``ts_col``) joined to a stream of requests (``request_id``,
    ``request_ts``, ``sdk_version``, keys) on request_id, with the
    impression at most ``max_delay`` after its request.

    Both watermarks and the time-range condition let Spark drop join state
    once neither side can still match, so state stays bounded by traffic
    within the delay instead of growing with history.

    ``keep_unmatched`` makes it a left outer join with a column ``matched``:
    an impression whose request is missing, too early or later than the
    watermark comes out once the watermark leaves no request for it, with
    NULL version and keys.
    """
    req = (
        requests.select(F.col("request_id").alias("_rid"), F.col("request_ts").cast("timestamp").alias("_req_ts"), "sdk_version", *keys)
        .withWatermark("_req_ts", watermark)
    )
    cond = (
        (F.col("request_id") == F.col("_rid"))
        & (F.col(ts_col) >= F.col("_req_ts"))
        & (F.col(ts_col) <= F.col("_req_ts") + F.expr(f"INTERVAL {max_delay}"))
    )
    if keep_unmatched:
        return events.join(req, cond, "left").withColumn("matched", F.col("_rid").isNotNull()).drop("_rid", "_req_ts")
    return events.join(req, cond).drop("_rid", "_req_ts")


def start_matching(
    events: DataFrame, requests: DataFrame, output_path: str, unmatched_path: str, checkpoint_path: str, keys: Sequence[str] = GUARDRAIL_KEYS, watermark: str = "2 days", state_partitions: int | None = None, **kw
) -> StreamingQuery:
    """Runs the outer :func:`join_request_stream` on all that has arrived:
    impressions with their request go to ``output_path``, the others to the side
    table ``unmatched_path``, both by ``batch_id=<epoch>`` and overwritten by a
    retried batch (exactly once with the checkpoint). The rows that may still
    match are the state: it lies on disk, in ``state_partitions`` parts."""
    out = join_request_stream(guardrail_events(events, watermark, dedup=False), requests, keys, watermark=watermark, keep_unmatched=True, **kw)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()  # two sinks, one run of the stateful plan
        try:
            for path, rows in ((output_path, batch.filter("matched")), (unmatched_path, batch.filter("not matched"))):
                rows.drop("matched").write.mode("overwrite").parquet(f"{path}/batch_id={epoch_id}")
        finally:
            batch.unpersist()

    w = out.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    with state_on_disk(out.sparkSession, state_partitions):
        return w.trigger(availableNow=True).start()


def replay_matching(
    events: DataFrame, requests: DataFrame, late: DataFrame | None = None, keys: Sequence[str] = GUARDRAIL_KEYS, watermark: str = "2 days", max_delay: str = "1 hour"
) -> tuple[DataFrame, DataFrame]:
    """Replays bare impressions (impression_id, request_id, ts, billable) and
    requests through :func:`start_matching`; returns matched and unmatched
    impressions. They arrive in two lots by time, the query restarting from its
    checkpoint between them; then rows far beyond the data move the watermark
    past all of them, and the ``late`` requests arrive behind it."""
    spark = events.sparkSession
    run = f"{ensure_checkpoint_dir(spark)}/auctionlens_matching/{uuid.uuid4().hex}"
    req = requests.select("request_id", "request_ts", "sdk_version", *keys)
    prev_tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        events.write.parquet(f"{run}/landed")
        landed = spark.read.parquet(f"{run}/landed")
        first, last, n_events = landed.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
        if last is None:
            return landed, landed
        parts = partitions_for(spark, n_events + req.count())
        half = F.lit(first).cast("timestamp_ntz") + (F.lit(last).cast("timestamp_ntz") - F.lit(first).cast("timestamp_ntz")) / 2

        def mark(df: DataFrame, ts: str, name: str, ahead: int) -> None:
            at = F.lit(last).cast("timestamp") + ahead * (F.expr(f"INTERVAL {watermark}") + F.expr(f"INTERVAL {watermark}") + F.expr(f"INTERVAL {max_delay}"))
            own = {ts: at, "request_id": F.lit("-1")}  # a NULL id would be filtered out before the watermark
            row = spark.range(1).select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
            row.write.mode("append").parquet(f"{run}/{name}")

        lots = [(landed.filter(F.col("ts") < half), req.filter(F.col("request_ts") < half)), (landed.filter(F.col("ts") >= half), req.filter(F.col("request_ts") >= half)), (None, None)]
        lots += [(None, late.select(*req.columns))] if late is not None else []
        for i, (e, r) in enumerate(lots):
            for name, df in (("events", e), ("requests", r)):
                if df is not None:
                    df.write.mode("append").parquet(f"{run}/{name}")
            if i >= 2:
                mark(landed, "ts", "events", i)
                mark(req, "request_ts", "requests", i)
            sources = [spark.readStream.schema(df.schema).parquet(f"{run}/{name}") for name, df in (("events", landed), ("requests", req))]
            q = start_matching(*sources, f"{run}/out", f"{run}/unmatched", f"{run}/checkpoint", keys, watermark, parts, max_delay=max_delay)
            q.awaitTermination()
            if q.exception() is not None:
                raise RuntimeError(str(q.exception()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev_tz)
    return tuple(spark.read.parquet(f"{run}/{x}").filter("impression_id is not null").drop("batch_id") for x in ("out", "unmatched"))


def start_guardrail_stream(
    spark: SparkSession,
    source_path: str,
    schema,
    output_path: str,
    checkpoint_path: str,
    base: str = BASE,
    cand: str = CAND,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    window: str = "1 day",
    slide: str | None = None,
    watermark: str = "2 days",
    min_n: int = 15,
    tol: float = 0.3,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    requests: DataFrame | None = None,
    z_min: float | None = None,
    latency_probs: Sequence[float] = (),
    alerts_path: str | None = None,
    dedup: bool = True,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """:func:`start_guardrail` on a folder of parquet files. A trigger takes all
    new files unless ``max_files_per_trigger`` limits it."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return start_guardrail(
        reader.parquet(source_path), output_path, checkpoint_path, base=base, cand=cand, keys=keys, window=window, slide=slide,
        watermark=watermark, min_n=min_n, tol=tol, available_now=available_now, processing_time=processing_time, requests=requests,
        z_min=z_min, latency_probs=latency_probs, alerts_path=alerts_path, dedup=dedup, state_partitions=state_partitions,
    )


def start_guardrail(
    stream: DataFrame,
    output_path: str,
    checkpoint_path: str,
    base: str = BASE,
    cand: str = CAND,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    window: str = "1 day",
    slide: str | None = None,
    watermark: str = "2 days",
    min_n: int = 15,
    tol: float = 0.3,
    available_now: bool = True,
    processing_time: str | None = None,
    requests: DataFrame | None = None,
    z_min: float | None = None,
    latency_probs: Sequence[float] = (),
    alerts_path: str | None = None,
    dedup: bool = True,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Start the guardrail on any streaming DataFrame of won impressions; returns
    the running query. ``slide`` makes the windows overlap.

    ``available_now`` processes what is in the folder and stops (for batch
    schedulers and tests); otherwise a processing-time trigger keeps it
    running. With ``requests`` the source only needs ``impression_id``,
    ``request_id``, ``ts`` and ``billable``; version and keys come from the
    static requests table. With ``alerts_path`` a ``foreachBatch`` sink
    writes each micro-batch's closed windows under ``output_path`` and its
    alert rows under ``alerts_path``, both in a ``batch_id=<epoch>`` folder
    written with overwrite, so a retried batch replaces its own output
    (exactly once with the checkpoint).

    ``state_partitions`` fixes the number of state-store partitions at the
    query's first start (it is then kept in the checkpoint). The window
    aggregate's state is small (open windows x cohorts), so a few
    partitions suffice; the dedup state grows with traffic and wants the
    session's larger default.
    """
    spark = stream.sparkSession
    ev = guardrail_events(stream, watermark, dedup=dedup)
    if requests is not None:
        ev = enrich_with_requests(ev, requests, keys)
    out = guardrail_windows(ev, base, cand, keys, window=window, slide=slide, min_n=min_n, tol=tol, z_min=z_min, latency_probs=latency_probs)
    if alerts_path is None:
        w = (
            out.writeStream.outputMode("append")
            .format("parquet")
            .option("path", output_path)
            .option("checkpointLocation", checkpoint_path)
        )
    else:

        def write_batch(batch: DataFrame, epoch_id: int) -> None:
            batch.persist()  # two sinks, one run of the stateful plan
            try:
                if batch.isEmpty():
                    return
                batch.write.mode("overwrite").parquet(f"{output_path}/batch_id={epoch_id}")
                batch.filter("alert").write.mode("overwrite").parquet(f"{alerts_path}/batch_id={epoch_id}")
            finally:
                batch.unpersist()

        w = out.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    with state_on_disk(spark, state_partitions):
        return w.start()


def replay_guardrail(
    won: DataFrame,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    window: str = "1 day",
    watermark: str = "2 days",
    min_n: int = 15,
    tol: float = 0.3,
    base: str = BASE,
    cand: str = CAND,
    dedup: bool = False,
    requests: DataFrame | None = None,
    files_per_trigger: int | None = None,
    slide: str | None = None,
) -> DataFrame:
    """Replay a batch of won impressions through the streaming guardrail and
    return every window, with ``closed``: whether the watermark of the data
    itself (latest event less the delay) has passed the window's end.

    The input is landed by one parallel write and read as a stream, by default
    in one trigger. A last row, far beyond the data and without any version,
    then moves the watermark past all windows, so append mode emits them all;
    that row's own window never closes. ``dedup`` is for sources that may
    deliver an impression twice, ``slide`` makes the windows overlap. With ``requests`` the source is bare
    impressions and the attributes come from that table (S01).
    """
    spark = won.sparkSession
    run = f"{ensure_checkpoint_dir(spark)}/auctionlens_stream/{uuid.uuid4().hex}"
    if requests is None:
        src = won.select("impression_id", "ts", "sdk_version", *keys, "billable")
    else:
        src = won.select("impression_id", "request_id", "ts", "billable")
    prev_tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # windows align to UTC midnight
    try:
        src.write.parquet(f"{run}/source")
        landed = spark.read.parquet(f"{run}/source")
        last, n_landed = landed.agg(F.max("ts"), F.count(F.lit(1))).first()
        if last is not None:
            beyond = F.lit(last).cast("timestamp") + F.expr(f"INTERVAL {watermark}") + F.expr(f"INTERVAL {window}") + F.expr(f"INTERVAL {window}")
            # no request has this id; a NULL one would be filtered out before the watermark
            end = {"ts": beyond.cast(src.schema["ts"].dataType), "request_id": F.lit("-1")}
            mark = spark.range(1).select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in src.schema.fields])
            mark.write.mode("append").parquet(f"{run}/source")
        q = start_guardrail_stream(
            spark, f"{run}/source", src.schema, f"{run}/out", f"{run}/checkpoint",
            base=base, cand=cand, keys=keys, window=window, slide=slide, watermark=watermark, min_n=min_n, tol=tol,
            max_files_per_trigger=files_per_trigger, dedup=dedup, requests=requests,
            state_partitions=partitions_for(spark, n_landed) if dedup else None,
        )
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev_tz)
    out = spark.read.parquet(f"{run}/out")
    if last is None:
        return out.withColumn("closed", F.lit(False))
    passed = F.lit(last).cast("timestamp_ntz") - F.expr(f"INTERVAL {watermark}")
    return out.withColumn("closed", F.col("window_end") <= passed)
