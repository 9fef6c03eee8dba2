"""Cohort lattice, mix by variable, error spikes, TTL frontier, planted contracts."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from auctionlens.operators import decompose, impact, lattice, quality, spikes
from auctionlens.sources.fixtures import FIXTURE_HINGE as H
from auctionlens.sources.fixtures import planted_tables
from conftest import SF001


def _traffic(seed, rate, n=3000, extra=()):
    """Requests and impressions of random cohorts, billable at ``rate(request)``."""
    rng = random.Random(seed)
    reqs, imps = [], []
    for i in range(n):
        q = dict(
            request_id=f"R{i}", sdk_version=rng.choice(["8.1.0", "8.2.0"]), os=rng.choice(["iOS", "Android"]),
            ad_format=rng.choice(["banner", "native", "interstitial"]), country=rng.choice(["US", "DE", "IN", None]),
        )
        q["os_version"] = rng.choice(["16.4", "17.0", "17.1"]) if q["os"] == "iOS" else rng.choice(["13", "14"])
        ok = rng.random() < rate(q)
        reqs.append(q)
        imps.append(dict(request_id=f"R{i}", impression_id=f"I{i}", billable=ok, revenue_usd=0.01 if ok else 0.0))
    return reqs, imps


def _found(df):
    return {r.cohort: r for r in df.collect()}


# --- D01 lattice ------------------------------------------------------------


def test_lattice_tells_the_shortest_descriptions(spark, micro):
    def rate(q):
        broken = q["sdk_version"] == "8.2.0" and (q["os_version"][:2] == "17" and q["ad_format"] == "banner" or q["os"] == "Android" and q["country"] is None)
        return 0.1 if broken else 0.9

    reqs, imps = _traffic(1, rate, n=8000)
    got = _found(lattice.cohort_lattice(micro(requests=reqs, impressions=imps)))
    # os_major=17 holds on iOS only, so naming the system would be longer
    assert set(got) == {"ad_format=banner, os_major=17", "country=(null), os=Android"}
    assert got["ad_format=banner, os_major=17"].implied == "os=iOS"
    assert {r.own_delta for r in got.values()} == {r.delta for r in got.values()}


def test_lattice_of_a_drop_everywhere_is_one_row(spark, micro):
    reqs, imps = _traffic(2, lambda q: 0.3 if q["sdk_version"] == "8.2.0" else 0.8)
    (r,) = lattice.cohort_lattice(micro(requests=reqs, impressions=imps)).collect()
    n = sum(q["sdk_version"] == "8.2.0" for q in reqs)
    assert (r.cohort, r.n_keys, r.n_cand, r.own_delta) == ("", 0, n, r.delta)


def test_lattice_without_a_drop_or_rows_is_empty(spark, micro):
    reqs, imps = _traffic(3, lambda q: 0.8)
    assert lattice.cohort_lattice(micro(requests=reqs, impressions=imps)).count() == 0
    assert lattice.cohort_lattice(micro()).count() == 0
    with pytest.raises(ValueError):
        lattice.cohort_lattice(micro(), keys=())


def test_lattice_tallies_before_the_cube(t001):
    from auctionlens.plans.inspect import exchanges

    df = lattice.cohort_lattice(t001, hinge=H)
    assert not [e for e in exchanges(df) if "(request_id" in e]
    assert {"ad_format=rewarded_video, os_major=17"} <= set(_found(df))


# --- D03 by variable ---------------------------------------------------------


def test_mix_parts_add_up_and_agree_with_the_strata(t001):
    strata = ("country", "os", "ad_format")
    plain = {r.metric: r for r in decompose.mix_standardized(t001, hinge=H, strata=strata).collect()}
    for r in decompose.mix_shapley(t001, hinge=H, variables=strata).collect():
        p = plain[r.metric]
        assert (r.total_pre, r.total_post, r.within, r.mix) == (p.total_pre, p.total_post, p.within, p.mix)
        assert abs(sum(r[f"mix_{v}"] for v in strata) - r.mix) < 3e-4
        again = {x.metric: x for x in decompose.mix_shapley(t001, hinge=H, variables=strata[::-1]).collect()}[r.metric]
        assert [again[f"mix_{v}"] for v in strata] == [r[f"mix_{v}"] for v in strata]


def test_mix_goes_to_the_variable_that_moved(spark, micro):
    from datetime import datetime

    def rows(tag, when, lots):
        reqs, imps = [], []
        for country, fmt, n, paid in lots:
            for i in range(n):
                rid = f"{tag}{country}{fmt}{i}"
                reqs.append(dict(request_id=rid, request_ts=when, country=country, ad_format=fmt))
                imps.append(dict(request_id=rid, impression_id=rid, billable=i < paid, revenue_usd=0.01 if i < paid else 0.0))
        return reqs, imps

    # rates by country alone and the same before and after; only the countries' shares move
    a = rows("a", datetime(2026, 5, 1), [("US", "x", 40, 32), ("US", "y", 40, 32), ("IN", "x", 10, 2), ("IN", "y", 10, 2)])
    b = rows("b", datetime(2026, 5, 30), [("US", "x", 10, 8), ("US", "y", 10, 8), ("IN", "x", 40, 8), ("IN", "y", 40, 8)])
    out = decompose.mix_shapley(micro(requests=a[0] + b[0], impressions=a[1] + b[1]), variables=("country", "ad_format"))
    got = {r.metric: r for r in out.collect()}
    r = got["billable_rate"]
    assert (r.total_pre, r.total_post, r.within, r.mix, r.mix_country, r.mix_ad_format) == (0.68, 0.32, 0.0, -0.36, -0.36, 0.0)
    assert decompose.mix_shapley(micro()).count() == 2  # a row a metric, without values


# --- D08 error control -------------------------------------------------------


def test_upper_tail_equals_erfc(spark):
    zs = [-40.0, -8.0, -3.0, -1.0, -0.999, -0.5, 0.0, 0.3, 0.999, 1.0, 1.5, 3.0, 8.0, 20.0, 37.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", spikes.upper_tail(F.col("z")).alias("p"))
    for r in df.collect():
        want = 0.5 * math.erfc(r.z / math.sqrt(2.0))
        assert r.p == pytest.approx(want, rel=1e-12), r


def test_q_values_equal_a_plain_procedure(t001):
    rows = spikes.error_spikes(t001, hinge=H).collect()
    cohorts = {(r.os, r.os_major, r.ad_format) for r in rows}
    codes = {r.error_code for r in rows}
    ps = []
    for r in rows:
        share = r.imps_cand / (r.imps_base + r.imps_cand)
        n = r.n_base + r.n_cand
        z = (r.n_cand - n * share - 0.5) / math.sqrt(n * share * (1 - share))
        ps.append(0.5 * math.erfc(z / math.sqrt(2)))
    m, least = len(cohorts) * len(codes), 1.0
    for rank, i in sorted(enumerate(sorted(range(len(ps)), key=ps.__getitem__), 1), reverse=True):
        least = min(least, ps[i] * m / rank)
        assert rows[i].q_value == pytest.approx(least, abs=1e-6) and rows[i].spike == (least <= 0.05)
    # the planted faults, in every system version that they strike, and nothing else
    assert {(r.os, r.os_major, r.ad_format, r.error_code) for r in rows if r.spike} == {
        ("iOS", "17", "rewarded_video", "RENDER_TIMEOUT"),
        *[("iOS", v, "interstitial", "OMID_NOT_REGISTERED") for v in ("16", "17", "18")],
    }


def test_spikes_of_odd_tables(spark, micro):
    assert spikes.error_spikes(micro()).count() == 0
    reqs = [dict(request_id="R1", sdk_version="8.2.0"), dict(request_id="R2", sdk_version="8.2.0", ad_format=None), dict(request_id="R3", ad_format=None)]
    imps = [dict(request_id=r["request_id"], impression_id=r["request_id"]) for r in reqs]
    ev = [dict(event_id=f"E{i}", request_id=r["request_id"], error_code="X") for i, r in enumerate(reqs)]
    (r,) = spikes.error_spikes(micro(requests=reqs, impressions=imps, events=ev)).collect()
    # R1's cohort has one version only; the cohort of no format has both
    assert (r.ad_format, r.n_base, r.n_cand, r.spike) == (None, 1, 1, False)


# --- D15 frontier ------------------------------------------------------------


def test_frontier_agrees_with_the_list_of_raises(t001):
    raises = (250, 500, 1000, 1500, 3000)
    listed = {r.delta_ms: r for r in impact.ttl_what_if(t001, hinge=H, deltas_ms=(0, *raises)).collect()}
    for width in (1, 100, 10_000):
        rows = sorted(impact.ttl_frontier(t001, hinge=H, budget_ms=1500, width_ms=width).collect())
        assert [r.recovered_imps for r in rows] == [sum(x.imps_at for x in rows[: i + 1]) for i in range(len(rows))]
        assert rows[-1].revenue_share == 1.0
        for up in raises:
            reached = [r for r in rows if r.delta_ms <= up][-1]
            assert reached.recovered_imps == listed[up].recovered_imps
            assert reached.recovered_revenue_usd == listed[up].recovered_revenue_usd
        assert [r.delta_ms for r in rows if r.best] == [max(r.delta_ms for r in rows if r.delta_ms <= 1500)]


def test_frontier_without_late_impressions_is_empty(micro):
    assert impact.ttl_frontier(micro()).count() == 0


# --- D14 planted -------------------------------------------------------------


def test_every_contract_is_broken_in_the_planted_tables(t001):
    rows = quality.contract_check(planted_tables(t001)).filter("check_name <> 'null_count'").collect()
    assert len(rows) == 24 and all(r.violations > 0 for r in rows)


def test_a_repeated_buyer_repeats_no_impression(micro):
    args = dict(
        requests=[dict(request_id="R1")],
        bids=[dict(bid_id="B1", request_id="R1", buyer_id=2, is_winner=0)],
        impressions=[dict(impression_id="I1", request_id="R1", winning_bid_id="B1")],
    )
    for buyers in ([(2, "a", "render")], [(2, "a", "render")] * 3, [(2, "a", "render"), (2, "b", "viewable")]):
        got = {r.check_name: r.violations for r in quality.contract_check(micro(**args, buyers=buyers)).collect() if r.check_name.startswith("rule_")}
        assert (got["rule_winning_bid_not_winner"], got["rule_billing_mismatch"]) == (1, 0)
