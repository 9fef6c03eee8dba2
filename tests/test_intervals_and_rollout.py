"""Intervals by bootstrap over days, and the rising rollout curve."""

from __future__ import annotations

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auctionlens.operators import impact, intervals, rollout
from auctionlens.sources.fixtures import FIXTURE_HINGE as H

DAY0 = datetime(2026, 5, 25, 12)


def _traffic(seed, rate, n=1500, days=20, **fixed):
    """Requests, bids and impressions on random days, billable at ``rate(request)``."""
    rng = random.Random(seed)
    reqs, bids, imps = [], [], []
    for i in range(n):
        q = dict(
            request_id=f"R{i}", request_ts=DAY0 + timedelta(days=rng.randrange(days)), sdk_version=rng.choice(["8.1.0", "8.2.0"]),
            os=rng.choice(["iOS", "Android"]), ad_format=rng.choice(["banner", "rewarded_video"]), os_version="17.0",
        ) | fixed
        ok = rng.random() < rate(q)
        reqs.append(q)
        bids.append(dict(bid_id=f"I{i}", request_id=f"R{i}", is_winner=1, cleared_price=4.0))
        imps.append(dict(request_id=f"R{i}", impression_id=f"I{i}", billable=ok, revenue_usd=0.004 if ok else 0.0))
    return reqs, bids, imps


def _weight(day, rep):
    u = int(hashlib.md5(f"{day}:{rep}".encode()).hexdigest()[:8], 16) / 2**32
    k, below = 0, math.exp(-1)
    while u >= below:
        k += 1
        below += math.exp(-1) / math.factorial(k)
    return k


def _central(values, level=0.95):
    values = sorted(values)
    at = lambda p: values[max(1, math.ceil(p * len(values))) - 1]
    return at((1 - level) / 2), at((1 + level) / 2)


# --- bootstrap --------------------------------------------------------------


def test_weights_are_poisson_and_repeatable(spark):
    x = spark.range(300).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    got = x.select("d", intervals.poisson_weights(F.col("d"), 50).alias("w")).collect()
    again = x.repartition(7).select("d", intervals.poisson_weights(F.col("d"), 50).alias("w")).collect()
    assert {r.d: r.w for r in got} == {r.d: r.w for r in again}
    assert all(r.w == [1, *(_weight(r.d, b) for b in range(1, 51))] for r in got)
    drawn = [w for r in got for w in r.w[1:]]
    mean = sum(drawn) / len(drawn)
    assert abs(mean - 1) < 0.03 and abs(sum((w - mean) ** 2 for w in drawn) / len(drawn) - 1) < 0.05


def test_impact_intervals_equal_a_plain_bootstrap(spark, micro):
    reqs, bids, imps = _traffic(1, lambda q: 0.3 if q["sdk_version"] == "8.2.0" else 0.9, os="iOS", ad_format="rewarded_video")
    t = micro(requests=reqs, bids=bids, impressions=imps)
    (got,) = intervals.impact_intervals(t, replicates=60).collect()
    rows = [(q["request_ts"].date(), q["sdk_version"] == "8.2.0", i["billable"]) for q, i in zip(reqs, imps, strict=True)]

    def lost(weight):
        nc, bc = (sum(weight(d) for d, new, ok in rows if new and (ok or not paid)) for paid in (False, True))
        nb, bb = (sum(weight(d) for d, new, ok in rows if not new and (ok or not paid)) for paid in (False, True))
        return bb / nb * nc - bc

    lo, hi = _central([lost(lambda d, b=b: _weight(d, b)) for b in range(1, 61)])
    assert got.lost_billable_imps == pytest.approx(lost(lambda d: 1), abs=0.006)
    assert (got.lost_billable_imps_lo, got.lost_billable_imps_hi) == (pytest.approx(lo, abs=0.006), pytest.approx(hi, abs=0.006))
    assert got.clear and got.n_replicates == 60
    (point,) = impact.counterfactual_impact(t).collect()
    assert point.lost_revenue_usd == got.lost_revenue_usd and point.rendered_cand == got.rendered_cand


def test_custom_cohorts_give_the_default_ones(t001):
    cases, prefilter = impact.default_impact_cohorts()
    plain = intervals.impact_intervals(t001, hinge=H, replicates=20).collect()
    assert sorted(intervals.impact_intervals(t001, hinge=H, cases=cases, prefilter=prefilter, replicates=20).collect()) == sorted(plain)


def test_difference_is_clear_only_where_it_was_planted(spark, micro):
    bad = lambda q: q["os"] == "iOS" and q["sdk_version"] == "8.2.0" and q["ad_format"] == "banner"
    reqs, bids, imps = _traffic(2, lambda q: 0.2 if bad(q) else 0.7, n=4000)
    t = micro(requests=reqs, bids=bids, impressions=imps)
    got = {r.ad_format: r for r in intervals.control_diff_intervals(t).collect()}
    assert got["banner"].clear and got["banner"].did_hi < -0.3
    assert not got["rewarded_video"].clear and got["rewarded_video"].did_lo < 0 < got["rewarded_video"].did_hi
    for r in got.values():
        assert r.did_lo <= r.did <= r.did_hi and r.n_replicates == intervals.REPLICATES


def test_an_interval_covers_the_truth_about_as_often_as_it_says(spark, micro):
    """40 formats without any effect: few of their 95 % intervals leave out zero."""
    rng = random.Random(3)
    reqs, bids, imps = _traffic(3, lambda q: 0.5, n=16000, days=40)
    for q in reqs:
        q["ad_format"] = f"f{rng.randrange(40)}"
    got = intervals.control_diff_intervals(micro(requests=reqs, bids=bids, impressions=imps)).collect()
    assert len(got) == 40 and sum(r.clear for r in got) <= 7


def test_intervals_without_a_cell_or_rows(spark, micro):
    assert intervals.control_diff_intervals(micro()).count() == 0
    assert intervals.impact_intervals(micro()).count() == 0
    reqs, bids, imps = _traffic(4, lambda q: 0.5, n=50, os="iOS")
    for r in intervals.control_diff_intervals(micro(requests=reqs, bids=bids, impressions=imps)).collect():
        assert (r.did, r.did_lo, r.did_hi, r.n_replicates, r.clear) == (None, None, None, 0, False)
    with pytest.raises(ValueError):
        intervals.impact_intervals(micro(), level=1.0)
    with pytest.raises(ValueError):
        intervals.impact_intervals(micro(), replicates=0)


def test_only_tallies_are_replicated(t001):
    from auctionlens.plans.inspect import formatted_plan, python_nodes

    df = intervals.impact_intervals(t001, hinge=H)
    assert not python_nodes(df)
    plan = formatted_plan(df)
    assert "PartitionFilters: [isnotnull(request_period" in plan


# --- rollout ----------------------------------------------------------------


def _pava(days):
    out = []
    for k, n in days:
        out.append([k, n, 1])
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            k2, n2, m2 = out.pop()
            out[-1] = [out[-1][0] + k2, out[-1][1] + n2, out[-1][2] + m2]
    return [tuple(b) for b in out]


def _daily(shares, os="iOS"):
    return [
        dict(request_id=f"{os}{d}-{j}", os=os, request_ts=DAY0 + timedelta(days=d), sdk_version="8.2.0" if j < k else "8.1.0")
        for d, (k, n) in enumerate(shares) for j in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_rollout_curve_equals_plain_pooling(spark, micro, seed):
    rng = random.Random(seed)
    series = {os: [(rng.randint(0, n), n) for n in [rng.randint(1, 9) for _ in range(40)]] for os in ("iOS", "Android")}
    got = rollout.rollout_curve(micro(requests=[q for os, s in series.items() for q in _daily(s, os)])).orderBy("os", "block").collect()
    for os, s in series.items():
        assert [(r.n_cand, r.n_requests, r.n_days) for r in got if r.os == os] == _pava(s)
        falls = [max(0.0, a[0] / a[1] - b[0] / b[1]) for a, b in zip(s, s[1:], strict=False)]
        assert sum(r.n_falls for r in got if r.os == os) == sum(f > 0 for f in falls)
        assert max(r.worst_fall for r in got if r.os == os) == pytest.approx(max(falls), abs=1e-4)


def test_rollout_majority_is_the_first_block_that_reaches_it(spark, micro):
    t = micro(requests=_daily([(0, 10), (2, 10), (1, 10), (6, 10), (9, 10), (9, 10)]))
    got = rollout.rollout_curve(t).orderBy("block").collect()
    assert [(r.share, r.n_days, r.majority) for r in got] == [(0.0, 1, False), (0.15, 2, False), (0.6, 1, True), (0.9, 2, False)]
    assert got[2].first_day == (DAY0 + timedelta(days=3)).date() and [r.n_falls for r in got] == [0, 1, 0, 0]
    never = rollout.rollout_curve(t, majority=0.95).collect()
    assert not any(r.majority for r in never)


def test_rollout_curve_of_few_rows(spark, micro):
    assert rollout.rollout_curve(micro()).count() == 0
    (one,) = rollout.rollout_curve(micro(requests=_daily([(1, 2)]) + [dict(request_id="x", request_ts=None)])).collect()
    assert (one.n_requests, one.share, one.majority, one.n_falls, one.worst_fall) == (2, 0.5, True, 0, 0.0)
    total = rollout.rollout_curve(micro(requests=_daily([(1, 2)] * 3) + _daily([(2, 2)], "Android")), keys=()).collect()
    assert sum(r.n_requests for r in total) == 8
