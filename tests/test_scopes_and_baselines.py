"""Micro cases for kept rows, onset, several versions and session settings."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auctionlens.functions.exprs import money
from auctionlens.operators import funnel, guardrail, impact, mechanism


def _auction(i, ts, revenue=1.0, **req):
    imp = {"impression_id": f"I{i}", "request_id": f"R{i}", "winning_bid_id": f"B{i}", "rendered": True, "billable": revenue > 0, "revenue_usd": revenue}
    return (
        {"request_id": f"R{i}", "request_ts": ts, **req},
        {"bid_id": f"B{i}", "request_id": f"R{i}", "is_winner": 1, "cleared_price": revenue * 1000},
        imp,
    )


def _tables(micro, auctions, **more):
    req, bids, imps = (list(x) for x in zip(*auctions, strict=True))
    return micro(requests=req, bids=bids, impressions=imps, **more)


def _days(levels, start=datetime(2026, 5, 1)):
    return [_auction(i, start + timedelta(days=i), revenue) for i, revenue in enumerate(levels)]


def test_onset_is_searched_from_the_hinge_on(micro):
    """A dip before the hinge is no onset; the planted fault after it is."""
    hinge = "2026-05-31"
    levels = [1.0] * 5 + [0.1] * 10 + [1.0] * 15 + [1.0] * 5 + [0.1] * 20
    row = funnel.decline_onset(_tables(micro, _days(levels)), hinge=hinge, ma_rows=1).first()
    assert (str(row["onset_day"]), row["days_after_hinge"]) == ("2026-06-05", 5)
    quiet = [1.0] * 5 + [0.1] * 10 + [1.0] * 30
    row = funnel.decline_onset(_tables(micro, _days(quiet)), hinge=hinge, ma_rows=1).first()
    assert row["onset_day"] is None and row["days_after_hinge"] is None


def test_unknown_publishers_are_counted(micro):
    t = _tables(micro, [_auction(1, datetime(2026, 5, 25), publisher_id=1), _auction(2, datetime(2026, 5, 25), publisher_id=999)])
    for scope in ("tier", "region"):
        rows = {r[scope] for r in funnel.publisher_scope(t, scope=scope).collect()}
        assert "unknown" in rows and len(rows) == 2


def test_error_labels_follow_the_system_and_keep_cohorts_without_impressions(micro, spark):
    auctions = [_auction(1, datetime(2026, 5, 25), os="Android", os_version="14", ad_format="interstitial", sdk_version="8.2.0")]
    t = micro(
        requests=[auctions[0][0]],
        events=[{"event_id": "E1", "request_id": "R1", "event_type": "render_error", "error_code": "X", "event_ts": datetime(2026, 5, 25)}],
    )
    assert [r["cohort"] for r in mechanism.error_trail(t, os="Android").collect()] == ["Android_interstitial"]
    row = mechanism.error_rate_vs_control(t, os="Android").first()
    assert (row["cohort"], row["n_cand"], row["imps_cand"], row["per_1000_cand"]) == ("Android_interstitial", 1, 0, None)


def test_guardrail_compares_every_version_with_the_incumbent(micro):
    day = datetime(2026, 5, 25)
    auctions = []
    for version, good in (("8.1.0", 18), ("8.2.0", 2), ("8.3.0", 17)):
        auctions += [_auction(len(auctions) + i, day, float(i < good), sdk_version=version) for i in range(20)]
    rows = {r["sdk_version"]: r for r in guardrail.guardrail_versions(_tables(micro, auctions)).collect()}
    assert set(rows) == {"8.2.0", "8.3.0"}
    assert rows["8.2.0"]["alert"] and rows["8.2.0"]["z_score"] > 3 and not rows["8.3.0"]["alert"]
    assert rows["8.3.0"]["n_base"] == 20 and rows["8.3.0"]["conv_base"] == 0.9


def test_control_group_is_the_baseline(micro):
    day = datetime(2026, 5, 25)
    auctions = []
    for os, good in (("iOS", 2), ("Android", 8)):
        auctions += [_auction(len(auctions) + i, day, 0.5 * (i < good), os=os, sdk_version="8.2.0") for i in range(10)]
    row = impact.counterfactual_vs_control(_tables(micro, auctions)).first()
    assert (row["rendered_cand"], row["billable_cand"], row["rendered_control"], row["control_br"]) == (10, 2, 10, 0.8)
    assert (row["lost_billable_imps"], row["lost_revenue_usd"]) == (6.0, 3.0)


def test_large_amounts_do_not_overflow(spark):
    df = spark.createDataFrame([(2_000_000.0,), (3e12,), (None,)], "revenue_usd double")
    assert float(df.agg(F.sum(money("revenue_usd"))).first()[0]) == 3e12 + 2e6


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from auctionlens.plans.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Context:
        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
