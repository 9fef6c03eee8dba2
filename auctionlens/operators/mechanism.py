"""Mechanism checks: A06 latency vs bid TTL, A07 billing-type split,
A08 error-code trail, D08 error rates against the base version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.exprs import case_label, count_if, dround, is_true, os_major, ratio, ts_lit
from auctionlens.operators.cohorts import DEFAULT_COHORT, _match, rendered_post
from auctionlens.operators.funnel import BASE, CAND, REFERENCE_HINGE, join_winning_bid
from auctionlens.sources.schema import AdTables

INTERSTITIAL_COHORT = {"os": "iOS", "ad_format": "interstitial"}


def _with_bid(x: DataFrame, t: AdTables, cols: Sequence[str], hinge: str | None = None) -> DataFrame:
    """Attach winning-bid columns (``bid_id`` join on ``winning_bid_id``)."""
    return join_winning_bid(x, t, cols, hinge=hinge)


def latency_vs_ttl(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    cohort: dict[str, str] | None = None,
    probs: Sequence[float] = (0.5, 0.95),
    mode: str = "exact",
    accuracy: int = 10000,
) -> DataFrame:
    """Render-latency percentiles, mean bid TTL and expired share per SDK
    version inside a cohort, post hinge.

    ``mode='exact'`` is the interpolating percentile (same as
    ``percentile_cont``). Rows are first counted per version and latency in
    milliseconds, which spreads a hot version over all tasks; one
    frequency-weighted percentile of all probabilities then reads those
    counts, a row per distinct latency. ``mode='approx'`` uses
    ``percentile_approx``, a sketch of fixed size whose value has a rank
    within ``n / accuracy`` of the asked one.
    """
    x = _with_bid(rendered_post(t, hinge, _match(cohort or DEFAULT_COHORT)), t, ["bid_ttl_ms"], hinge)
    lat, names = F.col("render_latency_ms"), [f"p{int(round(p * 100))}" for p in probs]
    expired = count_if(lat > F.col("bid_ttl_ms"))
    if mode == "exact":
        x = x.groupBy("sdk_version", "render_latency_ms").agg(
            F.count(F.lit(1)).alias("_n"), F.sum("bid_ttl_ms").alias("_ttl"), F.count("bid_ttl_ms").alias("_with_ttl"), expired.alias("_expired")
        )
        pct = F.percentile(lat, F.array(*[F.lit(float(p)) for p in probs]), F.col("_n"))
        g = x.groupBy("sdk_version").agg(
            F.sum("_n").alias("n"), pct.alias("_p"), F.sum("_ttl").alias("_ttl"), F.sum("_with_ttl").alias("_with_ttl"), F.sum("_expired").alias("_expired")
        )
    else:
        pct = F.percentile_approx(lat, [float(p) for p in probs], accuracy)
        g = x.groupBy("sdk_version").agg(
            F.count(F.lit(1)).alias("n"), pct.alias("_p"), F.sum("bid_ttl_ms").alias("_ttl"), F.count("bid_ttl_ms").alias("_with_ttl"), expired.alias("_expired")
        )
    return g.select(
        "sdk_version",
        F.col("n").cast("bigint").alias("n"),
        *[dround(F.get("_p", F.lit(i)), 0).alias(name) for i, name in enumerate(names)],
        dround(ratio("_ttl", "_with_ttl"), 0).alias("avg_ttl"),
        dround(ratio("_expired", "n"), 3).alias("expired_share"),
    ).orderBy(F.col("sdk_version").asc_nulls_last())


def billing_type_split(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    cohort: dict[str, str] | None = None,
) -> DataFrame:
    """Billable rate by buyer billing type and version, and the candidate's
    viewable rate, inside a cohort (iOS interstitial by default).

    Tallies are made per buyer first; only that result meets the buyers
    dimension and is rolled up by billing type, so no fact row is shuffled
    by buyer even when the dimension is too large to broadcast.
    """
    x = _with_bid(rendered_post(t, hinge, _match(cohort or INTERSTITIAL_COHORT)), t, ["buyer_id"], hinge)
    is_b, is_c, bill = F.col("sdk_version") == base, F.col("sdk_version") == cand, F.col("billable")
    per_buyer = x.groupBy("buyer_id").agg(
        count_if(is_b).alias("nb"),
        count_if(is_b & bill).alias("bb"),
        count_if(is_c).alias("nc"),
        count_if(is_c & bill).alias("bc"),
        count_if(is_c & is_true(F.col("viewable"))).alias("vc"),
    )
    g = per_buyer.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id").groupBy("billing_type").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("nb", "bb", "nc", "bc", "vc")]
    )
    return g.select(
        "billing_type",
        F.col("nb").alias("n_base"),
        F.col("nc").alias("n_cand"),
        dround(ratio("bb", "nb"), 3).alias("br_base"),
        dround(ratio("bc", "nc"), 3).alias("br_cand"),
        dround(ratio("vc", "nc"), 3).alias("viewable_rate_cand"),
    ).orderBy(F.col("billing_type").asc_nulls_last())


def signal_behavior(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    cohort: dict[str, str] | None = None,
) -> DataFrame:
    """Billing signals by buyer billing type, both versions: viewable, completion
    and billable rate of rendered impressions in a cohort (iOS interstitial by
    default), post hinge. Tallied per buyer before the buyers join."""
    x = _with_bid(rendered_post(t, hinge, _match(cohort or INTERSTITIAL_COHORT)), t, ["buyer_id"], hinge)
    hits = {"": F.lit(True), "viewable_": is_true(F.col("viewable")), "completed_": is_true(F.col("video_completed")), "billable_": is_true(F.col("billable"))}
    sides = {"base": F.col("sdk_version") == base, "cand": F.col("sdk_version") == cand}
    names = [f"{h}{v}" for h in hits for v in sides]
    per_buyer = x.groupBy("buyer_id").agg(*[count_if(on & hit).alias(f"{h}{v}") for h, hit in hits.items() for v, on in sides.items()])
    g = per_buyer.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id").groupBy("billing_type").agg(*[F.sum(n).cast("bigint").alias(n) for n in names])
    return g.select(
        "billing_type",
        *[F.col(v).alias(f"n_{v}") for v in sides],
        *[dround(ratio(f"{h}_{v}", v), 4).alias(f"{h}_rate_{v}") for h in ("viewable", "completed", "billable") for v in sides],
    ).orderBy(F.col("billing_type").asc_nulls_last())


def default_error_cohorts(os: str = "iOS") -> list[tuple[str, Column]]:
    # The error-trail cohort labels, after the operating system.
    return [
        (f"{os}17_rewarded_video", (F.col("ad_format") == "rewarded_video") & (os_major() == "17")),
        (f"{os}_interstitial", F.col("ad_format") == "interstitial"),
    ]


def error_label(os: str, cases: Sequence[tuple[str, Column]] | None, other: str | None) -> Column:
    """Cohort label of a request of ``os``; ``other`` defaults to ``other_<os>``."""
    return case_label(cases or default_error_cohorts(os), other or f"other_{os}")


def error_trail(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    cand: str = CAND,
    os: str = "iOS",
    cases: Sequence[tuple[str, Column]] | None = None,
    other: str | None = None,
) -> DataFrame:
    """Error-code counts per labelled cohort on the candidate version."""
    req = t.since(t.ad_requests, hinge).filter(
        (F.col("os") == os) & (F.col("sdk_version") == cand) & (F.col("request_ts") >= ts_lit(hinge))
    ).select("request_id", error_label(os, cases, other).alias("cohort"))
    ev = t.since(t.sdk_events, hinge).filter(F.col("error_code").isNotNull()).select("request_id", "error_code")
    out = ev.join(req, "request_id").groupBy("cohort", "error_code").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("cohort").asc_nulls_last(), F.col("n").desc_nulls_last())


def error_rate_vs_control(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    os: str = "iOS",
    cases: Sequence[tuple[str, Column]] | None = None,
    other: str | None = None,
) -> DataFrame:
    """Errors per 1000 impressions, candidate vs base version, per cohort
    and error code.

    Both sides are aggregated before they meet; the impression side has one
    row per cohort label (bounded by the number of cases), so it is
    broadcast without a count.
    """
    req = t.since(t.ad_requests, hinge).filter(
        (F.col("os") == os) & F.col("sdk_version").isin(base, cand) & (F.col("request_ts") >= ts_lit(hinge))
    ).select("request_id", "sdk_version", error_label(os, cases, other).alias("cohort"))
    is_b, is_c = F.col("sdk_version") == base, F.col("sdk_version") == cand
    errs = (
        t.since(t.sdk_events, hinge).filter(F.col("error_code").isNotNull())
        .select("request_id", "error_code")
        .join(req, "request_id")
        .groupBy("cohort", "error_code")
        .agg(count_if(is_b).alias("n_base"), count_if(is_c).alias("n_cand"))
    )
    imps = (
        t.since(t.impressions, hinge).select("request_id")
        .join(req, "request_id")
        .groupBy("cohort")
        .agg(count_if(is_b).alias("imps_base"), count_if(is_c).alias("imps_cand"))
    )
    # left: a cohort may have errors and no impression
    x = errs.join(F.broadcast(imps), "cohort", "left")
    return x.select(
        "cohort", "error_code", "n_base", "n_cand",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("imps_base", "imps_cand")],
        dround(ratio("n_base", "imps_base") * 1000.0, 3).alias("per_1000_base"),
        dround(ratio("n_cand", "imps_cand") * 1000.0, 3).alias("per_1000_cand"),
    )
