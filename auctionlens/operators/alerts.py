"""Alerts as events instead of a flag on every window.

A cohort's guardrail windows, in order, drive a one-sided CUSUM of the drop in
win-to-billable: s = max(0, s + drop - slack), in basis points (whole numbers,
so that batch and stream agree to the last digit). Windows with too few
impressions of either version take no part. Events of a cohort:

- ``open``: s reaches ``open_at``;
- ``update``: a further window while the alert is open;
- ``recovered``: s falls back to 0, the alert closes;
- ``escalate``: the alert is still open ``escalate_after`` after it opened (the
  "within 48 hours" rule as an event-time timer);
- ``silent``: no window for longer than ``quiet`` after the last one: an open
  alert closes, s starts anew.

Timer events happen at their own time, before a window that ends then, and have
no score. ``alert_events`` is the batch form (running sums, no loop); the
stream (``auctionlens.streaming.alerts``) gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.operators.guardrail import GUARDRAIL_KEYS, guardrail_batch
from auctionlens.sources.schema import AdTables

SLACK, OPEN_AT = 500, 3000
QUIET, ESCALATE_AFTER = "48 hours", "48 hours"


def scored(windows: DataFrame, keys: Sequence[str] = GUARDRAIL_KEYS, min_n: int = 15, slack: int = SLACK) -> DataFrame:
    """``keys``, window_end and x: what a window adds to the sum, in basis
    points. Works on batch and stream; windows with little traffic are dropped."""
    drop = F.round((F.col("conv_base") - F.col("conv_cand")) * 10_000).cast("bigint")
    enough = (F.col("n_base") >= min_n) & (F.col("n_cand") >= min_n)
    return windows.filter(enough).select(*keys, "window_end", (drop - slack).alias("x"))


def _after(ts: Column, interval: str) -> Column:
    return ts + F.expr(f"INTERVAL {interval}")


def events_of(
    scores: DataFrame, keys: Sequence[str] = GUARDRAIL_KEYS, open_at: int = OPEN_AT, quiet: str = QUIET, escalate_after: str = ESCALATE_AFTER
) -> DataFrame:
    """Events (keys, alert, event, at, score) of ``scored`` rows; the series'
    end counts as silence. ``alert`` numbers a cohort's alerts from 1.

    With c the running sum of x in a stretch without silence, s is
    c - min(0, least c so far); an alert is open where the last of the windows
    with s >= open_at or s = 0 was the former."""
    keys = list(keys)
    by = Window.partitionBy(*keys).orderBy(F.col("window_end").asc_nulls_last())
    x = scores.withColumn("new", F.coalesce(F.col("window_end") > _after(F.lag("window_end").over(by), quiet), F.lit(False)))
    x = x.withColumn("stretch", F.sum(F.col("new").cast("int")).over(by))
    of = Window.partitionBy(*keys, "stretch").orderBy(F.col("window_end").asc_nulls_last())
    x = x.withColumn("c", F.sum("x").over(of))
    x = x.withColumn("s", F.col("c") - F.least(F.lit(0), F.min("c").over(of)))
    decided = F.when(F.col("s") >= open_at, 1).when(F.col("s") == 0, 0)
    x = x.withColumn("on", F.coalesce(F.last(decided, ignorenulls=True).over(of), F.lit(0)))
    x = x.withColumn("was", F.coalesce(F.lag("on").over(of), F.lit(0)))
    x = x.withColumn("last", F.lead("window_end").over(of).isNull())
    x = x.withColumn("alert", F.sum(F.when((F.col("on") == 1) & (F.col("was") == 0), 1).otherwise(0)).over(by)).filter("on = 1 or was = 1")

    def event(name: Column, at: Column, score: Column) -> Column:
        return F.struct(name.alias("event"), at.alias("at"), score.alias("score"))

    def timer(name: str, at: Column) -> Column:
        return event(F.lit(name), at, F.lit(None).cast("bigint"))

    # Every step stays in the one sorted stream of a cohort: the windows' sorts are made once.
    name = F.when(F.col("was") == 0, "open").when(F.col("on") == 0, "recovered").otherwise("update")
    own = event(name, F.col("window_end"), F.col("s"))
    silent = timer("silent", _after(F.col("window_end"), quiet))
    rows = x.select(*keys, "alert", F.inline(F.when(F.col("last") & (F.col("on") == 1), F.array(own, silent)).otherwise(F.array(own))))
    # every alert opens once and closes once
    alert = Window.partitionBy(*keys, "alert")
    due = _after(F.min(F.when(F.col("event") == "open", F.col("at"))).over(alert), escalate_after)
    ends = F.max(F.when(F.col("event").isin("recovered", "silent"), F.col("at"))).over(alert)
    rows = rows.withColumns({"due": due, "ends": ends})
    own = event(F.col("event"), F.col("at"), F.col("score"))
    late = (F.col("event") == "open") & (F.col("due") <= F.col("ends"))
    rows = rows.select(*keys, "alert", F.inline(F.when(late, F.array(own, timer("escalate", F.col("due")))).otherwise(F.array(own))))
    return rows.withColumn("alert", F.col("alert").cast("bigint"))


def alert_events(
    t: AdTables, keys: Sequence[str] = GUARDRAIL_KEYS, window: str = "1 day", min_n: int = 15, slack: int = SLACK, open_at: int = OPEN_AT, quiet: str = QUIET, escalate_after: str = ESCALATE_AFTER
) -> DataFrame:
    """The alert events of the whole history."""
    windows = guardrail_batch(t, keys=keys, window=window, min_n=min_n)
    return events_of(scored(windows, keys, min_n, slack), keys, open_at, quiet, escalate_after)
