"""Alert events (batch, stream, restart), outer stream join, latency sketches
and change points, against folds and brute force."""

from __future__ import annotations

import random
import uuid
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from auctionlens.operators import alerts, segments, sketches
from auctionlens.plans.session import ensure_checkpoint_dir
from auctionlens.streaming.alerts import replay_alerts
from auctionlens.streaming.guardrail import guardrail_events, replay_matching

T0 = datetime(2026, 5, 20)
DAY = timedelta(days=1)


# --- alert life cycle -------------------------------------------------------


def _fold(scores, open_at, quiet, escalate_after):
    """Window by window; silence and escalation happen at their own time."""
    out = []
    for key in {(a, b) for a, b, _, _ in scores}:
        s, alert, opened, escalated, last = 0, 0, None, False, None
        rows = sorted((end, x) for a, b, end, x in scores if (a, b) == key)
        for end, x in [*rows, (None, 0)]:
            silent = last is not None and (end is None or end > last + quiet)
            until = last + quiet if silent else end
            if opened and not escalated and until is not None and opened + escalate_after <= until:
                out.append((*key, alert, "escalate", opened + escalate_after, None))
                escalated = True
            if silent:
                if opened:
                    out.append((*key, alert, "silent", last + quiet, None))
                s, opened = 0, None
            if end is None:
                break
            s, last = max(0, s + x), end
            if not opened and s >= open_at:
                alert, opened, escalated = alert + 1, end, False
                out.append((*key, alert, "open", end, s))
            elif opened:
                out.append((*key, alert, "update" if s else "recovered", end, s))
                opened = opened if s else None
    return set(out)


def _scores(seed):
    rng = random.Random(seed)
    rows = []
    for os_version, ad_format in [("17.0", "banner"), ("17.0", None), (None, "native"), ("18.0", "banner"), ("13", "x")]:
        end = T0
        for _ in range(rng.randrange(1, 60)):
            end += rng.choice([DAY, DAY, DAY, 2 * DAY, 5 * DAY])
            rows.append((os_version, ad_format, end, rng.choice([-4000, -2500, -600, 0, 900, 2500, 6000])))
    return rows


SCORES = "os_version string, ad_format string, window_end timestamp_ntz, x bigint"
LIFE = {"open_at": 3000, "quiet": "2 days", "escalate_after": "4 days"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_alert_events_equal_a_fold(spark, seed):
    rows = _scores(seed)
    got = alerts.events_of(spark.createDataFrame(rows, SCORES), **LIFE).collect()
    want = _fold(rows, 3000, 2 * DAY, 4 * DAY)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {e for _, _, _, e, _, _ in want} == {"open", "update", "recovered", "silent", "escalate"}


def test_alert_stream_equals_the_fold_over_restarts(spark):
    rows = _scores(4)
    got = replay_alerts(spark.createDataFrame(rows, SCORES), runs=3, **LIFE).collect()
    want = _fold(rows, 3000, 2 * DAY, 4 * DAY)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_alerts_of_no_windows(spark):
    none = spark.createDataFrame([], SCORES)
    assert alerts.events_of(none, **LIFE).count() == 0


def test_little_traffic_takes_no_part(spark):
    rows = [("17.0", "banner", T0, 20, 20, 0.9, 0.1), ("17.0", "banner", T0 + DAY, 20, 3, 0.9, 0.0), ("17.0", "banner", T0 + 2 * DAY, 0, 20, None, 0.5)]
    w = spark.createDataFrame(rows, "os_version string, ad_format string, window_end timestamp_ntz, n_base long, n_cand long, conv_base double, conv_cand double")
    assert [tuple(r) for r in alerts.scored(w, min_n=15).collect()] == [("17.0", "banner", T0, 7500)]


# --- outer stream-stream join ----------------------------------------------


def test_unmatched_impressions_are_kept(spark):
    won, req, late = [], [], []
    for i in range(400):
        ts = T0 + timedelta(hours=3 * i)
        won.append((f"I{i}", f"R{i}", ts, i % 3 == 0))
        delay = timedelta(minutes=(i % 5) * 20)  # up to 80 minutes; 60 are allowed
        row = (f"R{i}", ts - delay, "8.2.0", "17.0", "banner")
        if i % 10 == 3:
            late.append(row)
        elif i % 10 != 7:
            req.append(row)
    schema = "request_id string, request_ts timestamp_ntz, sdk_version string, os_version string, ad_format string"
    events = spark.createDataFrame(won, "impression_id string, request_id string, ts timestamp_ntz, billable boolean")
    matched, unmatched = replay_matching(events, spark.createDataFrame(req, schema), spark.createDataFrame(late, schema))
    want = {f"I{i}" for i in range(400) if i % 10 not in (3, 7) and i % 5 != 4}
    assert sorted(r["impression_id"] for r in matched.collect()) == sorted(want)
    rest = unmatched.collect()
    assert sorted(r["impression_id"] for r in rest) == sorted({f"I{i}" for i in range(400)} - want)
    assert {r["sdk_version"] for r in rest} == {None} and {r["sdk_version"] for r in matched.collect()} == {"8.2.0"}


# --- latency sketches ---------------------------------------------------------


def _latencies(spark, n=150_000):
    ts = F.lit("2026-01-05").cast("timestamp_ntz") + F.expr("make_dt_interval(cast(id % 180 as int))")
    return spark.range(n).select(
        ts.alias("ts"), F.when(F.col("id") % 3 == 0, "8.2.0").otherwise("8.1.0").alias("sdk_version"), F.element_at(F.array(F.lit("iOS"), F.lit("Android")), (F.col("id") % 2 + 1).cast("int")).alias("os"),
        F.lit("banner").alias("ad_format"), F.when(F.col("id") % 41 > 0, F.pmod(F.xxhash64("id"), F.lit(1000)) * F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3000)) / 1000).cast("int").alias("render_latency_ms"),
    )


def test_sketches_of_any_range_are_within_their_rank_error(spark):
    won = _latencies(spark)
    path = f"{ensure_checkpoint_dir(spark)}/test_sketch/{uuid.uuid4().hex}"
    sketches.store_sketches(sketches.latency_sketches(won), path)
    stored = spark.read.parquet(path)
    assert stored.count() == won.select(sketches.month().alias("m"), "sdk_version", "os").distinct().count()
    for since, until in [(None, None), ("2026-02-01", "2026-05-01"), ("2026-06-01", None)]:
        rows = won
        rows = rows.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz")) if since else rows
        rows = rows.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz")) if until else rows
        for keys in (("sdk_version",), ("sdk_version", "os")):
            got = sketches.sketch_quantiles(stored, keys, since=since, until=until)
            n = {tuple(r[k] for k in keys): r["n"] for r in got.collect()}
            assert n == {tuple(r[k] for k in keys): r["count"] for r in rows.filter("render_latency_ms is not null").groupBy(*keys).count().collect()}
            assert min(n.values()) > 10 * sketches.K  # far more rows than a sketch holds
            for r in sketches.rank_error(got, rows, keys).collect():
                assert r["p50_error"] <= 2 * sketches.RANK_ERROR and r["p95_error"] <= 2 * sketches.RANK_ERROR


def test_sketch_loads_replace_their_periods_and_prune(spark):
    won = _latencies(spark, 6000)
    path = f"{ensure_checkpoint_dir(spark)}/test_sketch/{uuid.uuid4().hex}"
    sketches.store_sketches(sketches.latency_sketches(won), path)
    before = {(r["period"], r["sdk_version"], r["os"]): r["n"] for r in spark.read.parquet(path).collect()}
    march = won.filter(sketches.month() == F.lit("2026-03-01").cast("date"))
    sketches.store_sketches(sketches.latency_sketches(march), path)  # the same month again
    again = spark.read.parquet(path)
    assert {(r["period"], r["sdk_version"], r["os"]): r["n"] for r in again.collect()} == before
    plan = sketches.sketch_quantiles(again, since="2026-04-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan


def test_sketches_run_on_a_stream(spark):
    won = _latencies(spark, 5000)
    run = f"{ensure_checkpoint_dir(spark)}/test_sketch/{uuid.uuid4().hex}"
    won.withColumn("impression_id", F.monotonically_increasing_id()).write.parquet(f"{run}/src")
    src = spark.readStream.schema(spark.read.parquet(f"{run}/src").schema).parquet(f"{run}/src")
    ev = guardrail_events(src, "1 day", dedup=False)
    out = sketches.latency_sketches(ev, period=F.window("ts", "30 days", "10 days"))  # sliding windows
    q = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{run}/ck").trigger(availableNow=True).start(f"{run}/out")
    q.awaitTermination()
    got = spark.read.parquet(f"{run}/out").select("period", "sdk_version", "os", "n", F.kll_sketch_get_n_bigint("sketch").alias("k")).collect()
    want = sketches.latency_sketches(won, period=F.window("ts", "30 days", "10 days")).select("period.start", "sdk_version", "os", "n").collect()
    want = {(r["start"], r["sdk_version"], r["os"]): r["n"] for r in want}
    assert len(got) > 20 and all(r["n"] == r["k"] == want[r["period"]["start"].replace(tzinfo=None), r["sdk_version"], r["os"]] for r in got)


# --- change points --------------------------------------------------------------


def _best_starts(x, penalty):
    """The least cost over every segmentation."""
    n = len(x)
    beta = penalty * np.log(n) * (np.diff(x) ** 2).mean() / 2
    best = None
    for k in range(n):
        for inner in combinations(range(1, n), k):
            cuts = [0, *inner, n]
            cost = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts[:-1], cuts[1:], strict=True)) + beta * k
            if best is None or cost < best[0] - 1e-9:
                best = (cost, cuts[:-1])
    return best[1]


def test_segments_are_the_best_of_all(spark):
    rng = np.random.default_rng(3)
    series = []
    for _ in range(12):
        cuts = sorted(rng.choice(np.arange(2, 11), rng.integers(0, 3), replace=False))
        level = np.zeros(12)
        for c in cuts:
            level[c:] += rng.choice([-4.0, 3.0])
        series.append((level + rng.normal(0, 0.6, 12)).round(3).tolist())
    series += [[], [1.0], [1.0, 5.0], [2.0] * 6]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(series)], "i int, x array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", segments.segment_starts(F.col("x"), 2.0).alias("s")).collect()}
    for i, x in enumerate(series[:12]):
        assert got[i] == _best_starts(np.array(x), 2.0)
    assert [got[i] for i in (12, 13, 14)] == [[0], [0], [0]]
    assert sorted(got[15]) == got[15] and got[15][0] == 0  # no noise, no penalty: all segmentations are equally good


def test_rows_without_a_value_follow_their_predecessor(spark):
    rows = [("a", d, None if d in (0, 9) else (1.0 if d < 8 else 9.0) + 0.1 * (d % 2)) for d in range(20)] + [(None, d, 1.0 * (d % 2)) for d in range(4)] + [("b", 0, None)]
    got = segments.with_segments(spark.createDataFrame(rows, "k string, d int, v double"), ["k"], "d", "v").collect()
    assert {(r["k"], r["d"]): r["segment"] for r in got} == {**{("a", d): 1 + (d >= 8) for d in range(20)}, **{(None, d): 1 for d in range(4)}, ("b", 0): 1}


def test_planted_faults_are_found_as_onsets(t001):
    from auctionlens.sources.fixtures import FIXTURE_HINGE

    rows = segments.ecpm_segments(t001, FIXTURE_HINGE, keys=("os", "ad_format"), bucket="90 days").collect()
    falls = {(r["os"], r["ad_format"]): r["first_bucket"] for r in rows if r["onset"] and r["change"] < -1 and r["n_buckets"] > 5}
    hinge = datetime.fromisoformat(FIXTURE_HINGE)
    assert set(falls) == {("iOS", "rewarded_video"), ("iOS", "interstitial")}
    assert all(abs(b - hinge) <= timedelta(days=90) for b in falls.values())
