"""Impact sizing: A09 counterfactual loss, D09 relative loss, D10 exposure,
D15 bid-TTL what-if."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.functions.exprs import MONEY_TYPE, any_of, case_label, count_if, dround, is_true, money, os_major, ratio
from auctionlens.operators.cohorts import DEFAULT_COHORT, _match, rendered_post
from auctionlens.operators.funnel import BASE, CAND, REFERENCE_HINGE, _billing_signal
from auctionlens.operators.mechanism import _with_bid
from auctionlens.sources.schema import AdTables


def default_impact_cohorts() -> tuple[list[tuple[str, Column]], Column]:
    """The two affected cohorts and the request-level filter they imply.

    The filter is the OR of the request parts of each label; it is applied
    before the joins so it reaches the request scan.
    """
    ios = F.col("os") == "iOS"
    a_req = ios & (os_major() == "17") & (F.col("ad_format") == "rewarded_video")
    b_req = ios & (F.col("ad_format") == "interstitial")
    # The counterfactual cohort labels.
    cases = [
        ("A: iOS17 rewarded_video (latency/TTL)", a_req),
        ("B: iOS interstitial, viewable buyers (OMID)", b_req & (F.col("billing_type") == "viewable")),
    ]
    return cases, any_of([a_req, b_req])


def cohort_impact_agg(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    cases: Sequence[tuple[str, Column]] | None = None,
    prefilter: Column | None = None,
    with_days: bool = False,
) -> DataFrame:
    """Per labelled cohort (post hinge, rendered): candidate volume and billed
    count, base billable rate and base price per billable impression.
    Rows in no cohort are dropped (a CASE without ELSE, then IS NOT NULL).

    The default cohorts are tallied per buyer before the buyers join (see
    :func:`_default_impact_agg`); custom ``cases`` may test any column, so
    they label rows after a row-level buyers join.
    """
    if cases is None:
        return _default_impact_agg(t, hinge, base, cand, with_days)
    x = _with_bid(rendered_post(t, hinge, prefilter), t, ["buyer_id"], hinge)
    x = x.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id")
    x = x.withColumn("cohort", case_label(cases)).filter(F.col("cohort").isNotNull())
    is_b, is_c, bill = F.col("sdk_version") == base, F.col("sdk_version") == cand, F.col("billable")
    x = x.withColumn("_rev", money("revenue_usd"))
    days = [F.count_distinct(F.when(is_c, F.to_date("request_ts"))).alias("active_days")] if with_days else []
    return x.groupBy("cohort").agg(
        count_if(is_c).alias("rendered_cand"),
        count_if(is_c & bill).alias("billable_cand"),
        ratio(count_if(is_b & bill), count_if(is_b)).alias("baseline_br"),
        ratio(
            F.sum(F.when(is_b & bill, F.col("_rev")).otherwise(F.lit(0).cast(MONEY_TYPE))).cast("double"),
            count_if(is_b & bill),
        ).alias("price_base"),
        *days,
    )


def default_impact_tallies(t: AdTables, hinge: str, base: str, cand: str, with_days: bool) -> DataFrame:
    """Tallies of the default cohorts, per cohort, buyer and, with ``with_days``,
    day ``_d``: rendered and billable impressions of the candidate (nc, bc) and the
    base (nb, bb), and the base's revenue (rb).

    The default cohorts depend on request attributes and, for B, on the
    buyer's billing type only. Impressions are tallied per (request-level
    cohort flags, buyer[, day]) at fact scale; only those tallies meet the
    buyers dimension, get their label, and are rolled up (counts and exact
    decimal sums are additive; active days are the days with candidate
    volume)."""
    (label_a, _), (label_b, _) = default_impact_cohorts()[0]
    ios = F.col("os") == "iOS"
    a_req = ios & (os_major() == "17") & (F.col("ad_format") == "rewarded_video")
    b_req = ios & (F.col("ad_format") == "interstitial")
    x = _with_bid(rendered_post(t, hinge, any_of([a_req, b_req])), t, ["buyer_id"], hinge)
    is_b, is_c, bill = F.col("sdk_version") == base, F.col("sdk_version") == cand, F.col("billable")
    day = [F.to_date("request_ts").alias("_d")] if with_days else []
    x = x.select(a_req.alias("_a"), b_req.alias("_b"), "buyer_id", *day, is_b.alias("_is_b"), is_c.alias("_is_c"), bill.alias("_bill"), money("revenue_usd").alias("_rev"))
    keys = ["_a", "_b", "buyer_id", *(["_d"] if with_days else [])]
    tallies = x.groupBy(*keys).agg(
        count_if(F.col("_is_c")).alias("nc"),
        count_if(F.col("_is_c") & F.col("_bill")).alias("bc"),
        count_if(F.col("_is_b")).alias("nb"),
        count_if(F.col("_is_b") & F.col("_bill")).alias("bb"),
        F.sum(F.when(F.col("_is_b") & is_true(F.col("_bill")), F.col("_rev")).otherwise(F.lit(0).cast(MONEY_TYPE))).alias("rb"),
    )
    y = tallies.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id")
    cohort = case_label([(label_a, F.col("_a")), (label_b, F.col("_b") & (F.col("billing_type") == "viewable"))])
    return y.withColumn("cohort", cohort).filter(F.col("cohort").isNotNull())


def _default_impact_agg(t: AdTables, hinge: str, base: str, cand: str, with_days: bool) -> DataFrame:
    y = default_impact_tallies(t, hinge, base, cand, with_days)
    sums = [F.sum(c).alias(c) for c in ("nc", "bc", "nb", "bb", "rb")]
    if with_days:
        y = y.groupBy("cohort", "_d").agg(*sums)
        extra = [count_if(F.col("nc") > 0).alias("active_days")]
    else:
        extra = []
    g = y.groupBy("cohort").agg(*sums, *extra)
    return g.select(
        "cohort",
        F.col("nc").cast("bigint").alias("rendered_cand"),
        F.col("bc").cast("bigint").alias("billable_cand"),
        ratio("bb", "nb").alias("baseline_br"),
        ratio(F.col("rb").cast("double"), "bb").alias("price_base"),
        *(["active_days"] if with_days else []),
    )


def _lost(agg: DataFrame) -> Column:
    return F.col("baseline_br") * F.col("rendered_cand") - F.col("billable_cand")


def counterfactual_impact(t: AdTables, hinge: str = REFERENCE_HINGE, base: str = BASE, cand: str = CAND, **kw) -> DataFrame:
    """Billable impressions and dollars lost had each cohort kept the base
    version's billable rate and price. ``GREATEST`` skips NULL, so a cohort
    without a baseline reports 0 lost impressions and NULL dollars."""
    a = cohort_impact_agg(t, hinge, base, cand, **kw)
    lost = _lost(a)
    return a.select(
        "cohort", "rendered_cand", "billable_cand",
        dround("baseline_br", 3).alias("baseline_br"),
        F.greatest(F.lit(0.0), dround(lost, 0)).cast("bigint").alias("lost_billable_imps"),
        dround(F.greatest(F.lit(0.0), lost) * F.col("price_base"), 4).alias("lost_revenue_usd"),
    ).orderBy(F.col("cohort").asc_nulls_last())


def counterfactual_vs_control(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    cand: str = CAND,
    os: str = "iOS",
    control_os: str = "Android",
) -> DataFrame:
    """A09 with the control group's rate: billable impressions and dollars lost
    had each ad format and billing type on ``os`` billed at the rate and price
    of the same candidate version on ``control_os``. Formats without control
    traffic report no baseline, 0 lost impressions and NULL dollars.

    Tallied per buyer before the buyers join; both sides are one aggregate."""
    on, ctl = F.col("os") == os, F.col("os") == control_os
    pred = (on | ctl) & (F.col("sdk_version") == cand)
    x = _with_bid(rendered_post(t, hinge, pred), t, ["buyer_id"], hinge)
    bill, zero = is_true(F.col("billable")), F.lit(0).cast(MONEY_TYPE)
    tallies = x.groupBy("buyer_id", "ad_format").agg(
        count_if(on).alias("nt"),
        count_if(on & bill).alias("bt"),
        count_if(ctl).alias("nc"),
        count_if(ctl & bill).alias("bc"),
        F.sum(F.when(ctl & bill, money("revenue_usd")).otherwise(zero)).alias("rc"),
    )
    g = tallies.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id").groupBy("ad_format", "billing_type").agg(*[F.sum(c).alias(c) for c in ("nt", "bt", "nc", "bc", "rc")])
    control = ratio("bc", "nc")
    lost = control * F.col("nt") - F.col("bt")
    return g.filter("nt > 0").select(
        "ad_format",
        "billing_type",
        F.col("nt").cast("bigint").alias("rendered_cand"),
        F.col("bt").cast("bigint").alias("billable_cand"),
        F.col("nc").cast("bigint").alias("rendered_control"),
        dround(control, 4).alias("control_br"),
        dround(F.greatest(F.lit(0.0), lost), 2).alias("lost_billable_imps"),
        dround(F.greatest(F.lit(0.0), lost) * ratio(F.col("rc").cast("double"), "bc"), 4).alias("lost_revenue_usd"),
    )


def relative_loss(t: AdTables, hinge: str = REFERENCE_HINGE, base: str = BASE, cand: str = CAND, **kw) -> DataFrame:
    """Lost share of the expected billable volume, and lost dollars per
    rendered candidate impression."""
    a = cohort_impact_agg(t, hinge, base, cand, **kw)
    expected = F.col("baseline_br") * F.col("rendered_cand")
    lost = F.greatest(F.lit(0.0), _lost(a))
    return a.select(
        "cohort", "rendered_cand", "billable_cand",
        dround(expected, 2).alias("expected_billable"),
        dround(F.try_divide(lost, expected), 4).alias("relative_loss"),
        dround(lost * F.col("price_base"), 4).alias("lost_revenue_usd"),
        dround(ratio(lost * F.col("price_base"), "rendered_cand"), 6).alias("lost_usd_per_rendered"),
    )


def exposure(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    days: int = 30,
    per_day: float | None = None,
    **kw,
) -> DataFrame:
    """exposure = affected rendered impressions per day x unit loss x days.

    Impressions per day come from the data (candidate rendered volume over
    its active days) unless ``per_day`` is given.
    """
    a = cohort_impact_agg(t, hinge, base, cand, with_days=True, **kw)
    unit = ratio(F.greatest(F.lit(0.0), _lost(a)) * F.col("price_base"), "rendered_cand")
    n_day = F.lit(float(per_day)) if per_day is not None else ratio("rendered_cand", "active_days")
    return a.select(
        "cohort",
        F.col("active_days").cast("bigint").alias("active_days"),
        dround(n_day, 2).alias("imps_per_day"),
        dround(unit, 6).alias("lost_usd_per_rendered"),
        F.lit(days).cast("bigint").alias("days"),
        dround(n_day * unit * F.lit(float(days)), 4).alias("exposure_usd"),
    )


def _ttl_tallies(t: AdTables, hinge: str, cand: str, cohort: dict[str, str] | None) -> tuple[DataFrame, Column]:
    """Impressions and exact revenue per outcome of the billing rule, and its signal."""
    pred = _match(cohort or DEFAULT_COHORT) & (F.col("sdk_version") == cand)
    x = _with_bid(rendered_post(t, hinge, pred), t, ["bid_ttl_ms", "cleared_price", "buyer_id"], hinge)
    tallies = x.groupBy(
        "buyer_id", "render_latency_ms", "bid_ttl_ms", "billable",
        is_true(F.col("viewable")).alias("_v"), is_true(F.col("video_completed")).alias("_c"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(money(F.col("cleared_price") / 1000.0)).alias("rev"))
    y = tallies.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id")
    return y, is_true(_billing_signal(F.col("billing_type"), F.col("_v"), F.col("_c")))


def ttl_what_if(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    cand: str = CAND,
    cohort: dict[str, str] | None = None,
    deltas_ms: Sequence[int] = (0, 250, 500, 1000, 1500, 2000),
) -> DataFrame:
    """Raise the bid TTL by each delta for a cohort's candidate traffic
    and recompute the billing rule; recovered impressions and revenue.

    An impression's outcome depends only on its latency, TTL, viewable and
    completed flags, billable flag and buyer, so impressions are tallied per
    such combination (revenue summed exactly) before the buyers join, and
    the ``len(deltas_ms)`` scenarios fan out over tallies, not impressions.
    """
    y, signal = _ttl_tallies(t, hinge, cand, cohort)
    y = y.select(
        F.explode(F.array(*[F.lit(int(d)) for d in deltas_ms])).alias("delta_ms"),
        "render_latency_ms", "bid_ttl_ms", "billable", "n", "rev", signal.alias("signal"),
    )
    would = is_true((F.col("render_latency_ms") <= F.col("bid_ttl_ms") + F.col("delta_ms")) & F.col("signal"))
    recovered = is_true(would & ~F.col("billable"))
    zero = F.lit(0).cast(MONEY_TYPE)
    return y.groupBy("delta_ms").agg(
        F.sum("n").cast("bigint").alias("n_rendered"),
        F.sum(F.when(is_true(F.col("billable")), F.col("n")).otherwise(0)).cast("bigint").alias("billable_now"),
        F.sum(F.when(would, F.col("n")).otherwise(0)).cast("bigint").alias("billable_whatif"),
        F.sum(F.when(recovered, F.col("n")).otherwise(0)).cast("bigint").alias("recovered_imps"),
        dround(F.sum(F.when(recovered, F.col("rev")).otherwise(zero)), 4).alias("recovered_revenue_usd"),
    ).select(F.col("delta_ms").cast("bigint").alias("delta_ms"), "n_rendered", "billable_now", "billable_whatif", "recovered_imps", "recovered_revenue_usd")


def ttl_frontier(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    cand: str = CAND,
    cohort: dict[str, str] | None = None,
    budget_ms: int = 1500,
    width_ms: int = 250,
) -> DataFrame:
    """D15 for every TTL: what each raise recovers, not only those of a list.

    What a raise recovers changes only where it reaches some unbilled impression whose
    signal is there, at ``latency - ttl``. One row per such raise (above 0): the impressions
    and revenue recovered in all and by it alone, their share of all recoverable revenue,
    and ``best`` for the raise that recovers most within ``budget_ms``.
    Without any recoverable impression there is no row.

    Raises are tallied first, then summed up in two steps: inside ranges of
    ``width_ms`` in parallel, and over the ranges' totals.
    """
    y, signal = _ttl_tallies(t, hinge, cand, cohort)
    raise_ms = F.col("render_latency_ms") - F.col("bid_ttl_ms")
    late = y.filter(signal & ~is_true(F.col("billable")) & (raise_ms > 0))
    steps = late.groupBy(raise_ms.cast("bigint").alias("delta_ms")).agg(F.sum("n").cast("bigint").alias("n"), F.sum("rev").cast("decimal(38,12)").alias("rev"))
    steps = steps.withColumn("_range", F.floor(F.col("delta_ms") / width_ms))
    ranges = steps.groupBy("_range").agg(F.sum("n").alias("_n"), F.sum("rev").cast("decimal(38,12)").alias("_rev"), F.max(F.when(F.col("delta_ms") <= budget_ms, F.col("delta_ms"))).alias("_last"))
    before = Window.orderBy(F.col("_range").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranges = ranges.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("_rev").over(before), F.lit(0)).cast("decimal(38,12)").alias("_rev"),
        F.sum("_rev").over(everything).cast("double").alias("_all"),
        F.max("_last").over(everything).alias("_best"),
    )
    inside = Window.partitionBy("_range").orderBy(F.col("delta_ms").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.withColumns({"_in": F.sum("n").over(inside), "_rev_in": F.sum("rev").over(inside).cast("decimal(38,12)")}).join(ranges, "_range")
    total = (F.col("_rev") + F.col("_rev_in")).cast("double")
    return sums.select(
        "delta_ms", F.col("n").alias("imps_at"), dround(F.col("rev").cast("double"), 4).alias("revenue_at_usd"),
        (F.col("_n") + F.col("_in")).cast("bigint").alias("recovered_imps"),
        dround(total, 4).alias("recovered_revenue_usd"),
        dround(ratio(total, "_all"), 4).alias("revenue_share"),
        F.coalesce(F.col("delta_ms") == F.col("_best"), F.lit(False)).alias("best"),
    )
