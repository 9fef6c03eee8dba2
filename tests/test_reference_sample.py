"""Operators on rows of the reference sample itself (string ids, its NULLs,
quoted commas, dotless OS versions). Expected values worked out by hand."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from auctionlens.functions.exprs import os_major
from auctionlens.operators import funnel, mechanism, quality
from auctionlens.sources.schema import SCHEMAS, AdTables

from conftest import BUYERS, PUBLISHERS

T = datetime.fromisoformat

# Rows of the reference sample, as loaded.
REQUESTS = [
    ("REQ_000001", T("2026-05-28 03:01:47"), 2, "app_23", "8.2.0", "iOS", "18.0", "iPad13,1", "IN", "interstitial", "plc_int_101"),
    ("REQ_000003", T("2026-05-20 08:04:13"), 5, "app_51", "8.1.0", "iOS", "18.0", "iPhone14,5", "JP", "interstitial", "plc_int_115"),
    ("REQ_000004", T("2026-05-11 21:56:34"), 4, "app_42", "8.1.0", "Android", "14", "SM-G991B", "BR", "rewarded_video", "plc_rew_132"),
    ("REQ_000005", T("2026-05-15 18:05:05"), 4, "app_43", "8.1.0", "Android", "15", "Pixel7", "DE", "interstitial", "plc_int_127"),
    ("REQ_000006", T("2026-05-24 07:17:42"), 3, "app_31", "8.1.0", "iOS", "18.0", "iPad13,1", "JP", "rewarded_video", "plc_rew_127"),
    ("REQ_000007", T("2026-05-25 00:05:59"), 4, "app_42", "8.2.0", "iOS", "17.1.2", "iPhone16,2", None, "interstitial", "plc_int_116"),
]
BIDS = [
    ("BID_0000001", "REQ_000001", 4, 1.6813, 1, 0, None, 1500),
    ("BID_0000002", "REQ_000001", 6, None, 0, 0, None, 1400),
    ("BID_0000003", "REQ_000001", 7, 2.2117, 1, 1, 1.7912, 1400),
    ("BID_0000004", "REQ_000001", 5, 1.709, 1, 0, None, 1500),
]
IMPRESSIONS = [
    ("IMP_000001", "REQ_000001", "BID_0000003", T("2026-05-28 03:01:47"), T("2026-05-28 03:01:47"), 877, True, False, False, True, 0.001791),
]
EVENTS = [
    ("EVT_0000001", "REQ_000001", "render_attempt", None, None, T("2026-05-28 03:01:47")),
    ("EVT_0000002", "REQ_000001", "render_success", None, 877, T("2026-05-28 03:01:47")),
    ("EVT_0000003", "REQ_000001", "measurement_error", "OMID_NOT_REGISTERED", None, T("2026-05-28 03:01:47")),
    ("EVT_0000004", "REQ_000001", "video_start", None, None, T("2026-05-28 03:01:47")),
]


@pytest.fixture(scope="module")
def sample(spark) -> AdTables:
    mk = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    return AdTables(
        ad_requests=mk("ad_requests", REQUESTS), bids=mk("bids", BIDS), impressions=mk("impressions", IMPRESSIONS),
        sdk_events=mk("sdk_events", EVENTS), buyers=mk("buyers", BUYERS), publishers=mk("publishers", PUBLISHERS),
    )


def test_funnel_keeps_only_days_with_all_three_grains(sample):
    (r,) = funnel.funnel_daily(sample).collect()
    assert (r.d, r.bid_rate, r.win_rate, r.render_rate, r.billable_rate, r.ecpm, r.ecpm_7d_avg) == (
        date(2026, 5, 28), 0.75, 1.0, 1.0, 1.0, 1.791, 1.791
    )


def test_render_billed_buyer_bills_without_viewability(sample):
    out = {r.stage: r.n for r in funnel.leak_stage(sample).collect()}
    assert out == {"billed": 1}


def test_error_trail_on_sample(sample):
    out = [tuple(r) for r in mechanism.error_trail(sample).collect()]
    assert out == [("iOS_interstitial", "OMID_NOT_REGISTERED", 1)]


def test_sample_satisfies_contracts_and_counts(sample):
    bad = [r for r in quality.contract_check(sample).collect() if r.check_name != "null_count" and r.violations]
    assert bad == []
    nulls = {(r.table_name, r.column_name): r.violations for r in quality.contract_check(sample).collect() if r.check_name == "null_count"}
    assert nulls[("ad_requests", "country")] == 1 and nulls[("bids", "bid_cpm")] == 1 and nulls[("sdk_events", "error_code")] == 3
    counts = {"ad_requests": 6, "bids": 4, "impressions": 1, "sdk_events": 4, "buyers": 8, "publishers": 6}
    assert all(r.ok for r in quality.load_verification(sample.as_dict(), counts).collect())


def test_quoted_comma_and_dotless_version_survive(sample):
    rows = {r.request_id: r for r in sample.ad_requests.select("request_id", "device_model", os_major().alias("m")).collect()}
    assert rows["REQ_000003"].device_model == "iPhone14,5" and rows["REQ_000004"].m == "14"


def test_command_line_on_reference_shaped_tables(spark, sample, capsys):
    import uuid

    from auctionlens.__main__ import main
    from auctionlens.plans.session import ensure_checkpoint_dir

    root = f"{ensure_checkpoint_dir(spark)}/test_ref_cli/{uuid.uuid4().hex}"
    for name, df in sample.as_dict().items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    main(["--tables", root, "--only", "load_verification,funnel_daily", "--out", f"{root}/out"])
    out = {r.t: r for r in spark.read.parquet(f"{root}/out/load_verification").collect()}
    assert out["buyers"].ok and out["publishers"].ok  # the reference dimensions are complete
    assert out["ad_requests"].n == 6 and out["ad_requests"].expected == 2600 and out["ad_requests"].ok is False
    assert spark.read.parquet(f"{root}/out/funnel_daily").count() == 1
    main(["--tables", root, "--store", f"{root}/stored", "--only", "funnel_daily", "--out", f"{root}/out2"])
    assert spark.read.parquet(f"{root}/out2/funnel_daily").collect() == spark.read.parquet(f"{root}/out/funnel_daily").collect()


def test_reference_style_version_names(sample):
    from auctionlens.functions.naming import reference_names, version_tag
    from auctionlens.operators import cohorts, impact

    assert version_tag("8.1.0") == "v81" and version_tag("10.2") == "v102"
    cols = reference_names(cohorts.cohort_version_compare(sample, min_n=0), "8.1.0", "8.2.0").columns
    assert cols == ["os", "os_major", "ad_format", "n_v81", "n_v82", "br_v81", "br_v82", "delta", "worst_rank"]
    cols = reference_names(impact.counterfactual_impact(sample), "8.1.0", "8.2.0").columns
    assert "rendered_v82" in cols and "billable_v82" in cols


def test_store_tables_gives_the_same_answers(spark, sample):
    """Reference-shaped tables laid out for scale (bucketed, day-partitioned)
    answer exactly as the raw ones."""
    import uuid

    from auctionlens.operators import cohorts, impact
    from auctionlens.plans.session import ensure_checkpoint_dir
    from auctionlens.sources.tables import store_tables

    root = f"{ensure_checkpoint_dir(spark)}/test_store/{uuid.uuid4().hex}"
    stored = store_tables(sample, root, buckets=4, time_unit="day")
    assert stored.time_partition == "request_period"
    for op in (funnel.funnel_daily, mechanism.error_trail, impact.counterfactual_impact, quality.contract_check,
               lambda t: cohorts.cohort_version_compare(t, min_n=0)):
        assert sorted(map(repr, op(stored).collect())) == sorted(map(repr, op(sample).collect()))
    flat = store_tables(sample, f"{root}-flat", buckets=3, time_unit=None)
    assert flat.time_partition is None
    assert funnel.funnel_daily(flat).collect() == funnel.funnel_daily(sample).collect()
