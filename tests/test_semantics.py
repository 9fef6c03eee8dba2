"""Micro tables, one per semantic rule of the reference."""

from __future__ import annotations

from datetime import datetime

import pytest
from auctionlens.functions.exprs import dround, era, os_major
from auctionlens.operators import cohorts, decompose, funnel, impact, mechanism, quality

D = datetime


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_m1_half_open_hinge_and_null_is_post(spark):
    df = spark.createDataFrame(
        [(D(2026, 5, 19, 23, 59),), (D(2026, 5, 20),), (None,)], "ts timestamp_ntz"
    ).select(era("ts", "2026-05-20").alias("e"))
    assert [r.e for r in df.collect()] == ["1_pre", "2_post", "2_post"]


def test_m8_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.0625,), (-0.0625,), (1.005,)], "x double").select(dround("x", 3).alias("r"))
    assert [r.r for r in df.collect()] == [0.063, -0.063, 1.005]


def test_r48_split_part_ragged_versions(spark):
    df = spark.createDataFrame([("17.1.2",), ("14",), (None,)], "v string").select(os_major("v").alias("m"))
    assert [r.m for r in df.collect()] == ["17", "14", None]


def test_m2_m4_m17_funnel_null_handling(micro):
    t = micro(
        requests=[
            {"request_id": "R1", "request_ts": D(2026, 5, 1, 1)},
            {"request_id": "R2", "request_ts": D(2026, 5, 1, 2)},  # no bids at all: not won
        ],
        bids=[
            {"bid_id": "B1", "request_id": "R1", "did_bid": 1, "is_winner": 1, "cleared_price": 4.0},
            {"bid_id": "B2", "request_id": "R1", "did_bid": 0, "bid_cpm": None},
        ],
        impressions=[
            {"impression_id": "B1", "request_id": "R1", "rendered": True, "billable": True, "revenue_usd": None},
            {"impression_id": "X2", "request_id": "R1", "rendered": None, "billable": False, "revenue_usd": 0.0},
        ],
    )
    (r,) = rows(funnel.funnel_daily(t))
    assert r["bid_rate"] == 0.5  # 1 of 2 bids
    assert r["win_rate"] == 0.5  # R2 has no bids -> not won, still counted
    assert r["render_rate"] == 0.5  # NULL rendered counts as not rendered
    assert r["billable_rate"] == 1.0  # over rendered rows only
    assert r["ecpm"] == 0.0  # NULL revenue -> 0, row kept in the denominator


def test_m5_zero_denominator_is_null(micro):
    t = micro(
        requests=[{"request_id": "R1"}],
        bids=[{"bid_id": "B1", "request_id": "R1", "is_winner": 1}],
        impressions=[{"impression_id": "B1", "request_id": "R1", "rendered": False, "billable": False, "revenue_usd": 0.0}],
    )
    (r,) = rows(funnel.funnel_daily(t))
    assert r["billable_rate"] is None and r["ecpm"] is None and r["render_rate"] == 0.0


def test_m9_moving_average_is_rows_not_days(micro):
    days = [D(2026, 5, d) for d in (1, 2, 3, 4, 5, 6, 7, 20)]  # gap before the 8th row
    reqs = [{"request_id": f"R{i}", "request_ts": d} for i, d in enumerate(days)]
    bids = [{"bid_id": f"B{i}", "request_id": f"R{i}", "is_winner": 1} for i in range(len(days))]
    imps = [{"impression_id": f"B{i}", "request_id": f"R{i}", "revenue_usd": 0.001 * (i + 1)} for i in range(len(days))]
    out = rows(funnel.funnel_daily(micro(requests=reqs, bids=bids, impressions=imps)))
    assert [r["ecpm"] for r in out] == [float(i + 1) for i in range(8)]
    assert out[-1]["ecpm_7d_avg"] == 5.0  # mean of rows 2..8 (ecpm 2..8), not of a 7-day span
    assert out[0]["ecpm_7d_avg"] == 1.0


def test_m18_day_missing_from_a_grain_disappears(micro):
    t = micro(
        requests=[{"request_id": "R1", "request_ts": D(2026, 5, 1)}, {"request_id": "R2", "request_ts": D(2026, 5, 2)}],
        bids=[{"bid_id": "B1", "request_id": "R1", "is_winner": 1}, {"bid_id": "B2", "request_id": "R2"}],
        impressions=[{"impression_id": "B1", "request_id": "R1"}],
    )
    out = rows(funnel.funnel_daily(t))
    assert [str(r["d"]) for r in out] == ["2026-05-01"]


def _cohort_rows(n, os_, ver, fmt, ver_s, billable_k):
    reqs, imps = [], []
    for i in range(n):
        rid = f"{os_}{ver}{fmt}{ver_s}{i}"
        reqs.append({"request_id": rid, "os": os_, "os_version": ver, "ad_format": fmt, "sdk_version": ver_s})
        imps.append({"impression_id": rid, "request_id": rid, "billable": i < billable_k})
    return reqs, imps


def test_m11_m12_volume_filter_before_rank(micro):
    reqs, imps = [], []
    for spec in [
        ("iOS", "17.0", "rewarded_video", "8.1.0", 20, 18), ("iOS", "17.0", "rewarded_video", "8.2.0", 20, 1),
        ("iOS", "18.0", "banner", "8.1.0", 20, 10), ("iOS", "18.0", "banner", "8.2.0", 20, 9),
        # thin cohort with the worst delta: must not take rank 1
        ("Android", "14", "native", "8.1.0", 3, 3), ("Android", "14", "native", "8.2.0", 3, 0),
    ]:
        r, i = _cohort_rows(spec[4], spec[0], spec[1], spec[2], spec[3], spec[5])
        reqs += r
        imps += i
    out = rows(cohorts.cohort_version_compare(micro(requests=reqs, impressions=imps), min_n=15))
    assert [(r["os_major"], r["worst_rank"]) for r in out] == [("17", 1), ("18", 2)]
    assert out[0]["br_base"] == 0.9 and out[0]["br_cand"] == 0.05 and out[0]["delta"] == -0.85


def test_m10_null_delta_ranks_last(micro):
    reqs, imps = [], []
    for spec in [("iOS", "17.0", "banner", "8.1.0", 2, 1), ("iOS", "17.0", "banner", "8.2.0", 2, 0),
                 ("iOS", "18.0", "banner", "8.2.0", 2, 0)]:  # no pre rows -> NULL delta
        r, i = _cohort_rows(spec[4], spec[0], spec[1], spec[2], spec[3], spec[5])
        reqs += [{**x, "request_ts": D(2026, 5, 1) if x["sdk_version"] == "8.1.0" else D(2026, 5, 25)} for x in r]
        imps += i
    out = rows(cohorts.cohort_pre_post(micro(requests=reqs, impressions=imps), keys=["os", "os_version", "ad_format"]))
    by = {r["os_version"]: r for r in out}
    assert by["18.0"]["br_pre"] is None and by["18.0"]["decline_rank"] == 2
    assert by["17.0"]["delta"] == -0.5 and by["17.0"]["decline_rank"] == 1


def test_m13_no_baseline_reports_zero_lost_and_null_dollars(micro):
    reqs = [{"request_id": "R1", "sdk_version": "8.2.0"}]
    bids = [{"bid_id": "R1", "request_id": "R1", "is_winner": 1, "buyer_id": 2}]
    imps = [{"impression_id": "R1", "request_id": "R1", "billable": False, "revenue_usd": 0.0}]
    (r,) = rows(impact.counterfactual_impact(micro(requests=reqs, bids=bids, impressions=imps)))
    assert r["baseline_br"] is None and r["lost_billable_imps"] == 0 and r["lost_revenue_usd"] is None


def test_m14_rows_in_no_cohort_are_dropped(micro):
    reqs = [
        {"request_id": "A", "sdk_version": "8.2.0"},  # iOS 17 rewarded -> cohort A
        {"request_id": "N", "sdk_version": "8.2.0", "ad_format": "banner"},  # no cohort
        {"request_id": "B", "sdk_version": "8.1.0", "ad_format": "interstitial"},  # viewable buyer -> B
    ]
    bids = [{"bid_id": x, "request_id": x, "is_winner": 1, "buyer_id": 1} for x in "ANB"]
    imps = [{"impression_id": x, "request_id": x} for x in "ANB"]
    out = rows(impact.counterfactual_impact(micro(requests=reqs, bids=bids, impressions=imps)))
    assert [r["cohort"][0] for r in out] == ["A", "B"]


def test_m15_partition_vs_overlap_scopes(micro):
    reqs = [{"request_id": "U", "country": "US"}, {"request_id": "I", "country": "IN"}, {"request_id": "Z", "country": None}]
    imps = [{"impression_id": x, "request_id": x} for x in "UIZ"]
    t = micro(requests=reqs, impressions=imps)
    part = {r["scope"]: r for r in rows(decompose.geo_mix_control(t, scope_mode="partition"))}
    over = {r["scope"]: r for r in rows(decompose.geo_mix_control(t, scope_mode="overlap"))}
    assert part["All geos (blended)"]["low_ecpm_geo_share"] == 1.0  # non-US rows only
    assert over["All geos (blended)"]["low_ecpm_geo_share"] == 0.5  # true blend, NULL country removed
    with pytest.raises(ValueError):
        decompose.geo_mix_control(t, scope_mode="bogus")


def test_m16_null_country_filtered_before_banding(micro):
    reqs = [
        {"request_id": "H", "country": "US"},
        {"request_id": "Z", "country": None, "sdk_version": "8.2.0"},
    ]
    imps = [{"impression_id": x, "request_id": x} for x in "HZ"]
    out = rows(cohorts.stratified_compare(micro(requests=reqs, impressions=imps)))
    assert [(r["geo_band"], r["n_base"], r["n_cand"]) for r in out] == [("high_ecpm_geo", 1, 0)]


def test_m19_null_latency_not_expired_and_skipped_by_percentile(micro):
    reqs = [{"request_id": f"R{i}", "sdk_version": "8.2.0"} for i in range(3)]
    bids = [{"bid_id": f"R{i}", "request_id": f"R{i}", "is_winner": 1, "bid_ttl_ms": 1000} for i in range(3)]
    lat = [500, 3000, None]
    imps = [{"impression_id": f"R{i}", "request_id": f"R{i}", "render_latency_ms": lat[i]} for i in range(3)]
    (r,) = rows(mechanism.latency_vs_ttl(micro(requests=reqs, bids=bids, impressions=imps)))
    assert r["n"] == 3 and r["p50"] == 1750.0 and r["expired_share"] == 0.333


def test_m3_viewable_is_true_in_billing_split(micro):
    reqs = [{"request_id": f"R{i}", "ad_format": "interstitial", "sdk_version": "8.2.0"} for i in range(2)]
    bids = [{"bid_id": f"R{i}", "request_id": f"R{i}", "is_winner": 1, "buyer_id": 1} for i in range(2)]
    imps = [{"impression_id": "R0", "request_id": "R0", "viewable": None}, {"impression_id": "R1", "request_id": "R1", "viewable": True}]
    (r,) = rows(mechanism.billing_type_split(micro(requests=reqs, bids=bids, impressions=imps)))
    assert r["billing_type"] == "viewable" and r["viewable_rate_cand"] == 0.5


def test_error_trail_labels(micro):
    reqs = [
        {"request_id": "A", "sdk_version": "8.2.0"},
        {"request_id": "B", "sdk_version": "8.2.0", "ad_format": "interstitial"},
        {"request_id": "O", "sdk_version": "8.2.0", "ad_format": "banner"},
        {"request_id": "V", "sdk_version": "8.1.0"},  # base version: excluded
    ]
    ev = [
        {"event_id": "E1", "request_id": "A", "event_type": "render_timeout", "error_code": "RENDER_TIMEOUT"},
        {"event_id": "E2", "request_id": "A", "event_type": "render_timeout", "error_code": "RENDER_TIMEOUT"},
        {"event_id": "E3", "request_id": "B", "event_type": "measurement_error", "error_code": "OMID_NOT_REGISTERED"},
        {"event_id": "E4", "request_id": "O", "event_type": "render_error", "error_code": "RENDER_FAILED"},
        {"event_id": "E5", "request_id": "V", "event_type": "render_error", "error_code": "RENDER_FAILED"},
        {"event_id": "E6", "request_id": "A", "event_type": "render_attempt", "error_code": None},
    ]
    out = rows(mechanism.error_trail(micro(requests=reqs, events=ev)))
    assert [(r["cohort"], r["error_code"], r["n"]) for r in out] == [
        ("iOS17_rewarded_video", "RENDER_TIMEOUT", 2),
        ("iOS_interstitial", "OMID_NOT_REGISTERED", 1),
        ("other_iOS", "RENDER_FAILED", 1),
    ]


def test_contract_check_counts_violations(micro):
    reqs = [{"request_id": "R1"}]
    bids = [
        {"bid_id": "B1", "request_id": "R1", "is_winner": 1, "cleared_price": 4.0},
        {"bid_id": "B1", "request_id": "R1"},  # duplicate key
        {"bid_id": "B2", "request_id": "R9", "did_bid": 0, "bid_cpm": 1.0},  # orphan + cpm rule
    ]
    imps = [{"impression_id": "I1", "request_id": "R1", "winning_bid_id": "B2", "rendered": False, "billable": True}]
    out = {(r["check_name"], r["table_name"], r["column_name"]): r["violations"] for r in rows(quality.contract_check(micro(requests=reqs, bids=bids, impressions=imps)))}
    assert out[("pk_duplicate", "bids", "bid_id")] == 1
    assert out[("fk_orphan", "bids", "request_id")] == 1
    assert out[("rule_cpm_null_iff_no_bid", "bids", "bid_cpm")] == 1
    assert out[("rule_billable_not_rendered", "impressions", "billable")] == 1
    assert out[("rule_latency_null_iff_not_rendered", "impressions", "render_latency_ms")] == 1
    assert out[("rule_winning_bid_other_request", "impressions", "winning_bid_id")] == 1
    assert out[("rule_winning_bid_not_winner", "impressions", "winning_bid_id")] == 1
    assert out[("null_count", "bids", "cleared_price")] == 2
    assert out[("rule_billing_mismatch", "impressions", "billable")] == 1  # billed although not rendered
    assert out[("rule_complete_ts_null_iff_not_rendered", "impressions", "render_complete_ts")] == 0
    assert out[("rule_video_null_iff_not_video_format", "impressions", "video_completed")] == 0
    assert out[("pk_duplicate", "ad_requests", "request_id")] == 0


def test_contract_check_counts_every_copy_of_a_winning_bid(micro):
    good = {"bid_id": "B1", "request_id": "R1", "is_winner": 1, "cleared_price": 4.0}
    bad = {"bid_id": "B1", "request_id": "R2", "is_winner": 0, "cleared_price": 8.0, "bid_ttl_ms": 100}
    t = micro(
        requests=[{"request_id": "R1"}, {"request_id": "R2"}],
        bids=[good, good, bad, bad, bad],
        impressions=[{"impression_id": "I1", "request_id": "R1", "winning_bid_id": "B1"}, {"impression_id": "I2", "request_id": "R1", "winning_bid_id": "B9"}],
    )
    out = {(r["check_name"], r["column_name"]): r["violations"] for r in rows(quality.contract_check(t)) if r["table_name"] in ("bids", "impressions")}
    assert out[("pk_duplicate", "bid_id")] == 4 and out[("fk_orphan", "winning_bid_id")] == 1
    assert out[("rule_winning_bid_other_request", "winning_bid_id")] == 3
    assert out[("rule_winning_bid_not_winner", "winning_bid_id")] == 3
    assert out[("rule_revenue_not_cleared_price", "revenue_usd")] == 3
    assert out[("rule_billing_mismatch", "billable")] == 3 + 1  # no bid: nothing to bill


def test_load_verification_literal_and_frame_expectations(micro, spark):
    t = micro(requests=[{"request_id": "R1"}, {"request_id": "R2"}])
    out = {r["t"]: r for r in rows(quality.load_verification(t.as_dict(), {"ad_requests": 2, "buyers": spark.range(3)}))}
    assert out["ad_requests"]["ok"] is True and out["buyers"]["ok"] is False
    assert out["buyers"]["n"] == 8 and out["bids"]["expected"] is None and out["bids"]["ok"] is None


def test_ttl_what_if_recovers_expired(micro):
    reqs = [{"request_id": f"R{i}", "sdk_version": "8.2.0"} for i in range(2)]
    bids = [{"bid_id": f"R{i}", "request_id": f"R{i}", "is_winner": 1, "bid_ttl_ms": 1000, "cleared_price": 2.0} for i in range(2)]
    imps = [
        {"impression_id": "R0", "request_id": "R0", "render_latency_ms": 1400, "billable": False, "revenue_usd": 0.0},
        {"impression_id": "R1", "request_id": "R1", "render_latency_ms": 900, "billable": True, "revenue_usd": 0.002},
    ]
    out = {r["delta_ms"]: r for r in rows(impact.ttl_what_if(micro(requests=reqs, bids=bids, impressions=imps), deltas_ms=(0, 500)))}
    assert out[0]["recovered_imps"] == 0 and out[500]["recovered_imps"] == 1
    assert out[500]["recovered_revenue_usd"] == 0.002 and out[500]["billable_whatif"] == 2


def test_strings_and_bigint_ids_agree(micro, spark):
    """Operators only use id equality: string ids (reference) work like bigint ids (testdata)."""
    t = micro(
        requests=[{"request_id": "REQ_000007"}],
        bids=[{"bid_id": "BID_1", "request_id": "REQ_000007", "is_winner": 1}],
        impressions=[{"impression_id": "IMP_1", "winning_bid_id": "BID_1", "request_id": "REQ_000007"}],
    )
    assert funnel.funnel_daily(t).count() == 1
