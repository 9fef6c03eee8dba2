"""The alert life cycle as a stateful stream (``transformWithStateInPandas``).

The source are closed guardrail windows, as the guardrail stream's sink holds
them. State is kept by cohort in RocksDB: the CUSUM, the open alert and the time
of the last window, a few numbers each. Silence and escalation are event-time
timers, so they fire from the watermark also when a cohort sends nothing more.
Windows of one trigger are taken in order of their end. The events are those of
``operators.alerts.events_of`` over the same windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auctionlens.operators.alerts import ESCALATE_AFTER, OPEN_AT, QUIET
from auctionlens.operators.guardrail import GUARDRAIL_KEYS
from auctionlens.plans.session import ensure_checkpoint_dir
from auctionlens.streaming.state import state_on_disk

STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("s", "alert", "opened", "escalated", "last")])
NOT_OPEN = -1


class AlertLifeCycle(StatefulProcessor):
    """CUSUM, open alert and timers of one cohort; times are in milliseconds."""

    def __init__(self, keys: Sequence[str], open_at: int, quiet: int, escalate_after: int):
        self.keys, self.open_at, self.quiet, self.escalate_after = list(keys), open_at, quiet, escalate_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cohort", STATE)

    def _load(self) -> dict:
        row = self.state.get() if self.state.exists() else (0, 0, NOT_OPEN, 0, NOT_OPEN)
        return dict(zip(STATE.fieldNames(), row, strict=True))

    def _due(self, c: dict) -> list[tuple[int, str]]:
        """Timer events still to come, by time."""
        due = []
        if c["opened"] != NOT_OPEN and not c["escalated"]:
            due.append((c["opened"] + self.escalate_after, "escalate"))
        if c["opened"] != NOT_OPEN or c["s"] > 0:
            due.append((c["last"] + self.quiet, "silent"))
        return sorted(due)  # of one time the escalation comes first

    def _fire(self, c: dict, now: int, out: list, window: bool) -> None:
        """Timer events up to ``now``; a window that ends just when silence
        would begin is no silence."""
        while due := [x for x in self._due(c) if x[0] < now or (x[0] == now and not (window and x[1] == "silent"))]:
            at, event = due[0]
            if event == "escalate":
                out.append((c["alert"], "escalate", at, None))
                c["escalated"] = 1
            else:
                if c["opened"] != NOT_OPEN:
                    out.append((c["alert"], "silent", at, None))
                c["s"], c["opened"] = 0, NOT_OPEN

    def _save(self, c: dict) -> None:
        self.state.update(tuple(int(c[n]) for n in STATE.fieldNames()))
        wanted, there = {at for at, _ in self._due(c)}, set(self.handle.listTimers())
        for at in there - wanted:
            self.handle.deleteTimer(at)
        for at in wanted - there:
            self.handle.registerTimer(at)

    def _rows(self, key: tuple, out: list) -> Iterator[pd.DataFrame]:
        if out:
            alert, event, at, score = zip(*out, strict=True)
            own = {k: pd.Series([v] * len(out), dtype=object) for k, v in zip(self.keys, key, strict=True)}
            yield pd.DataFrame({**own, "alert": alert, "event": event, "at": pd.to_datetime(at, unit="ms"), "score": pd.array(score, dtype="Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c, out = self._load(), []
        got = pd.concat(list(rows))
        ends = got["window_end"]
        ends = (ends.dt.tz_localize(None) if ends.dt.tz is not None else ends).astype("datetime64[ms]").astype("int64")
        for end, x in sorted(zip(ends.tolist(), got["x"].tolist(), strict=True)):
            if pd.isna(x):
                continue  # moves the watermark only
            self._fire(c, end, out, window=True)
            c["s"] = max(0, c["s"] + int(x))
            if c["opened"] == NOT_OPEN and c["s"] >= self.open_at:
                c["alert"], c["opened"], c["escalated"] = c["alert"] + 1, end, 0
                out.append((c["alert"], "open", end, c["s"]))
            elif c["opened"] != NOT_OPEN:
                out.append((c["alert"], "update" if c["s"] else "recovered", end, c["s"]))
                c["opened"] = c["opened"] if c["s"] else NOT_OPEN
            c["last"] = end
        self._save(c)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c, out = self._load(), []
        self._fire(c, expiredTimerInfo.getExpiryTimeInMs(), out, window=False)
        self._save(c)
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def _ms(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def start_alerts(
    scores: DataFrame,
    output_path: str,
    checkpoint_path: str,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    open_at: int = OPEN_AT,
    quiet: str = QUIET,
    escalate_after: str = ESCALATE_AFTER,
    watermark: str = "0 seconds",
    available_now: bool = True,
) -> StreamingQuery:
    """Starts the life cycle on a stream of ``operators.alerts.scored`` rows;
    events are appended to a parquet sink, exactly once over restarts.

    ``watermark``: how much later than others a window may arrive. Keys are
    text columns. The state store is RocksDB, which timers need."""
    spark = scores.sparkSession
    ev = scores.withColumn("window_end", F.col("window_end").cast("timestamp")).withWatermark("window_end", watermark)
    schema = T.StructType(
        [*[T.StructField(k, T.StringType()) for k in keys], T.StructField("alert", T.LongType()), T.StructField("event", T.StringType()), T.StructField("at", T.TimestampNTZType()), T.StructField("score", T.LongType())]
    )
    machine = AlertLifeCycle(keys, open_at, _ms(quiet), _ms(escalate_after))
    out = ev.groupBy(*keys).transformWithStateInPandas(machine, schema, "Append", "EventTime")
    w = out.writeStream.outputMode("append").format("parquet").option("path", output_path).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    with state_on_disk(spark):
        return w.start()


def replay_alerts(scores: DataFrame, keys: Sequence[str] = GUARDRAIL_KEYS, runs: int = 2, quiet: str = QUIET, escalate_after: str = ESCALATE_AFTER, **kw) -> DataFrame:
    """Replays a batch of scored windows through the stream and returns its
    events: the windows arrive in ``runs`` lots, by time, and the query is
    stopped and restarted from its checkpoint after each. A last row far beyond
    them, of no cohort, moves the watermark past all timers."""
    spark = scores.sparkSession
    run = f"{ensure_checkpoint_dir(spark)}/auctionlens_alerts/{uuid.uuid4().hex}"
    prev_tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        scores.write.parquet(f"{run}/scores")
        landed = spark.read.parquet(f"{run}/scores")
        cuts = [r["at"] for r in landed.groupBy(F.col("window_end").alias("at")).count().orderBy(F.col("at").asc_nulls_last()).select("at").collect()]  # a row a window of the calendar
        steps = [cuts[len(cuts) * i // runs] for i in range(1, runs)] if len(cuts) >= runs else []
        bounds = [None, *steps, None]
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            part = landed.filter(F.col("window_end") >= F.lit(lo)) if lo is not None else landed
            part = part.filter(F.col("window_end") < F.lit(hi)) if hi is not None else part
            part.write.mode("append").parquet(f"{run}/source")
            if i == len(bounds) - 2 and cuts:
                beyond = F.lit(cuts[-1]) + F.expr(f"INTERVAL {quiet}") + F.expr(f"INTERVAL {escalate_after}") + F.expr("INTERVAL 1 day")
                end = {"window_end": beyond}
                mark = spark.range(1).select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in scores.schema.fields])
                mark.write.mode("append").parquet(f"{run}/source")
            q = start_alerts(spark.readStream.schema(scores.schema).parquet(f"{run}/source"), f"{run}/out", f"{run}/checkpoint", keys, quiet=quiet, escalate_after=escalate_after, **kw)
            q.awaitTermination()
            if q.exception() is not None:
                raise RuntimeError(str(q.exception()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev_tz)
    return spark.read.parquet(f"{run}/out")
