"""Hand-checked micro cases for the analyses whose formulas are ours."""

from __future__ import annotations

from datetime import datetime, timedelta

from auctionlens.operators import cohorts, decompose, funnel, guardrail, impact, mechanism

D = datetime


def test_d05_difference_in_differences(micro):
    reqs, imps = [], []
    # treated (iOS): base 4/4 billed, cand 1/4; control (Android): base 4/4, cand 4/4
    for os_, ver, billed in [("iOS", "8.1.0", 4), ("iOS", "8.2.0", 1), ("Android", "8.1.0", 4), ("Android", "8.2.0", 4)]:
        for i in range(4):
            rid = f"{os_}{ver}{i}"
            reqs.append({"request_id": rid, "os": os_, "sdk_version": ver, "ad_format": "banner"})
            imps.append({"impression_id": rid, "request_id": rid, "billable": i < billed})
    (r,) = [x.asDict() for x in cohorts.control_diff(micro(requests=reqs, impressions=imps)).collect()]
    assert (r["diff_treated"], r["diff_control"], r["did"], r["did_rank"]) == (-0.75, 0.0, -0.75, 1)


def test_d06_onset_needs_a_full_run_below_threshold(micro):
    # 14 pre-hinge days at eCPM 10, then 10 days at 5: the 7-row mean falls below
    # 90% of 10 on the 2nd low day (mean of 5 tens + 2 fives = 8.57) and stays there.
    start = D(2026, 5, 6)
    days = [start + timedelta(days=i) for i in range(24)]
    reqs = [{"request_id": f"R{i}", "request_ts": d} for i, d in enumerate(days)]
    bids = [{"bid_id": f"R{i}", "request_id": f"R{i}", "is_winner": 1} for i in range(24)]
    imps = [{"impression_id": f"R{i}", "request_id": f"R{i}", "revenue_usd": 0.01 if i < 14 else 0.005} for i in range(24)]
    r = funnel.decline_onset(micro(requests=reqs, bids=bids, impressions=imps), drop=0.10, run=7).first().asDict()
    assert r["baseline_ecpm"] == 10.0 and r["threshold_ecpm"] == 9.0
    assert r["onset_day"] == (start + timedelta(days=15)).date()
    assert r["days_after_hinge"] == 1


def test_d07_running_share_per_os(micro):
    reqs = [
        {"request_id": "a", "request_ts": D(2026, 5, 1), "os": "iOS", "sdk_version": "8.2.0"},
        {"request_id": "b", "request_ts": D(2026, 5, 1), "os": "iOS"},
        {"request_id": "c", "request_ts": D(2026, 5, 2), "os": "iOS", "sdk_version": "8.2.0"},
        {"request_id": "d", "request_ts": D(2026, 5, 1), "os": "Android"},
    ]
    out = {(r.os, str(r.d)): r for r in funnel.rollout_adoption(micro(requests=reqs)).collect()}
    assert out[("iOS", "2026-05-01")].cand_share == 0.5
    assert out[("iOS", "2026-05-02")].cum_cand_share == 0.6667
    assert out[("Android", "2026-05-01")].cum_cand_share == 0.0


def test_d08_rates_per_thousand(micro):
    reqs = [{"request_id": f"R{i}", "sdk_version": "8.2.0" if i < 2 else "8.1.0"} for i in range(4)]
    imps = [{"impression_id": f"R{i}", "request_id": f"R{i}"} for i in range(4)]
    ev = [{"event_id": "E1", "request_id": "R0", "event_type": "render_timeout", "error_code": "RENDER_TIMEOUT"}]
    (r,) = mechanism.error_rate_vs_control(micro(requests=reqs, impressions=imps, events=ev)).collect()
    assert (r.cohort, r.n_cand, r.n_base, r.imps_cand, r.imps_base) == ("iOS17_rewarded_video", 1, 0, 2, 2)
    assert (r.per_1000_cand, r.per_1000_base) == (500.0, 0.0)


def test_d09_d10_relative_loss_and_exposure(micro):
    reqs, bids, imps = [], [], []
    # cohort A: base 4 rendered, 4 billed at $0.002; cand 10 rendered on 2 days, 1 billed
    for i in range(14):
        ver = "8.1.0" if i < 4 else "8.2.0"
        rid = f"R{i}"
        reqs.append({"request_id": rid, "sdk_version": ver, "request_ts": D(2026, 5, 21 + (i % 2), 10)})
        bids.append({"bid_id": rid, "request_id": rid, "is_winner": 1, "buyer_id": 2})
        billed = i < 4 or i == 4
        imps.append({"impression_id": rid, "request_id": rid, "billable": billed, "revenue_usd": 0.002 if billed else 0.0})
    t = micro(requests=reqs, bids=bids, impressions=imps)
    (a,) = impact.counterfactual_impact(t).collect()
    assert (a.rendered_cand, a.billable_cand, a.baseline_br, a.lost_billable_imps, a.lost_revenue_usd) == (10, 1, 1.0, 9, 0.018)
    (r,) = impact.relative_loss(t).collect()
    assert (r.expected_billable, r.relative_loss, r.lost_usd_per_rendered) == (10.0, 0.9, 0.0018)
    (e,) = impact.exposure(t, days=30).collect()
    assert (e.active_days, e.imps_per_day, e.exposure_usd) == (2, 5.0, 0.27)


def test_d02_d03_identities_on_micro(micro):
    reqs = [
        {"request_id": "p1", "request_ts": D(2026, 5, 1), "country": "US"},
        {"request_id": "p2", "request_ts": D(2026, 5, 1), "country": "IN"},
        {"request_id": "q1", "request_ts": D(2026, 5, 25), "country": "US"},
        {"request_id": "q2", "request_ts": D(2026, 5, 25), "country": "IN"},
        {"request_id": "q3", "request_ts": D(2026, 5, 25), "country": "IN"},
    ]
    rev = {"p1": 0.004, "p2": 0.002, "q1": 0.004, "q2": 0.002, "q3": 0.0}
    imps = [{"impression_id": k, "request_id": k, "revenue_usd": v, "billable": v > 0} for k, v in rev.items()]
    t = micro(requests=reqs, impressions=imps)
    m = {r.metric: r for r in decompose.mix_standardized(t, strata=("country",)).collect()}
    e = m["ecpm"]
    # pre 3.0; post 2.0; within = 0.5*(4-4) + 0.5*(1-2) = -0.5; mix = (1/3-1/2)*4 + (2/3-1/2)*1 = -0.5
    assert (e.total_pre, e.total_post, e.within, e.mix) == (3.0, 2.0, -0.5, -0.5)
    a = decompose.ecpm_attribution(t).first()
    assert abs(a.billable_share + a.price_share - 1.0) < 1e-3


def test_s03_sliding_windows(micro):
    reqs = [{"request_id": f"R{i}", "request_ts": D(2026, 5, 1, 10 + i)} for i in range(3)]
    imps = [{"impression_id": f"R{i}", "request_id": f"R{i}"} for i in range(3)]
    out = guardrail.guardrail_batch(micro(requests=reqs, impressions=imps), window="2 hours", slide="1 hour", min_n=1).collect()
    per_start = {r.window_start.hour: r.n_base for r in out}
    assert per_start == {9: 1, 10: 2, 11: 2, 12: 1}
