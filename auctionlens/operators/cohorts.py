"""Cohort isolation: A04 version-vs-version by cohort, A05 stratified
compare, D01 pre-vs-post by full cohort, D05 treated-vs-control diff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.functions.exprs import (
    ERA_POST,
    ERA_PRE,
    count_if,
    dround,
    era,
    os_major,
    ratio,
    ts_lit,
    version_rate,
)
from auctionlens.operators.decompose import LOW_ECPM_COUNTRIES
from auctionlens.operators.funnel import BASE, CAND, REFERENCE_HINGE
from auctionlens.sources.schema import AdTables

REQUEST_COLS = ["request_ts", "sdk_version", "os", "os_version", "ad_format", "country"]


def rendered_post(t: AdTables, hinge: str, request_filter: Column | None = None) -> DataFrame:
    """Rendered impressions of requests at or after the hinge, with request
    attributes and ``os_major``. Both filters reach the parquet scans, and
    on time-partitioned tables both scans skip pre-hinge partitions."""
    req = t.since(t.ad_requests, hinge).select("request_id", *REQUEST_COLS).filter(F.col("request_ts") >= ts_lit(hinge))
    if request_filter is not None:
        req = req.filter(request_filter)
    imps = t.since(t.impressions, hinge).filter(F.col("rendered")).select(
        "request_id", "winning_bid_id", "billable", "viewable", "video_completed", "render_latency_ms", "revenue_usd"
    )
    return imps.join(req, "request_id").withColumn("os_major", os_major())


def _version_pivot(base: str, cand: str, hit: Column) -> list[Column]:
    n_b, r_b = version_rate("sdk_version", base, hit)
    n_c, r_c = version_rate("sdk_version", cand, hit)
    return [n_b.alias("n_base"), n_c.alias("n_cand"), r_b.alias("br_base"), r_c.alias("br_cand")]


def cohort_version_compare(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    keys: Sequence[str] = ("os", "os_major", "ad_format"),
    min_n: int = 15,
    k: int = 12,
) -> DataFrame:
    """Billable rate of two SDK versions side by side per cohort, post hinge.

    Thin cohorts are dropped *before* ranking; rank runs on the unrounded
    delta over the surviving cohorts (one row each, so the global window is
    bounded by cohort cardinality); top-k by rounded delta with explicit
    tie-breakers so the cut is deterministic.
    """
    keys = list(keys)
    c = rendered_post(t, hinge).groupBy(*keys).agg(*_version_pivot(base, cand, F.col("billable")))
    c = c.filter((F.col("n_base") >= min_n) & (F.col("n_cand") >= min_n))
    delta = F.col("br_cand") - F.col("br_base")
    c = c.withColumn("worst_rank", F.rank().over(Window.orderBy(delta.asc_nulls_last())).cast("bigint"))
    out = c.select(
        *keys, "n_base", "n_cand",
        dround("br_base", 3).alias("br_base"),
        dround("br_cand", 3).alias("br_cand"),
        dround(delta, 3).alias("delta"),
        "worst_rank",
    )
    order = [F.col("delta").asc_nulls_last(), F.col("worst_rank").asc_nulls_last()] + [F.col(x).asc_nulls_last() for x in keys]
    return out.orderBy(*order).limit(k)


DEFAULT_COHORT = {"os": "iOS", "os_major": "17", "ad_format": "rewarded_video"}


def _match(cohort: dict[str, str]) -> Column:
    out = F.lit(True)
    for c, v in cohort.items():
        out = out & ((os_major() if c == "os_major" else F.col(c)) == F.lit(v))
    return out


def geo_band(low_set: Sequence[str] = LOW_ECPM_COUNTRIES) -> Column:
    return F.when(F.col("country").isin(list(low_set)), F.lit("low_ecpm_geo")).otherwise(F.lit("high_ecpm_geo"))


def stratified_compare(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    cohort: dict[str, str] | None = None,
    stratum: Column | None = None,
    stratum_name: str = "geo_band",
) -> DataFrame:
    """The version comparison for one cohort inside strata (geo bands by
    default). NULL country is removed before banding."""
    pred = _match(cohort or DEFAULT_COHORT) & F.col("country").isNotNull()
    x = rendered_post(t, hinge, pred).withColumn(stratum_name, stratum if stratum is not None else geo_band())
    agg = x.groupBy(stratum_name).agg(*_version_pivot(base, cand, F.col("billable")))
    return agg.select(
        stratum_name, "n_base", "n_cand",
        dround("br_base", 3).alias("br_base"),
        dround("br_cand", 3).alias("br_cand"),
    ).orderBy(F.col(stratum_name).asc_nulls_last())


def cohort_pre_post(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    keys: Sequence[str] = ("sdk_version", "os", "os_version", "ad_format"),
    min_n: int = 0,
) -> DataFrame:
    """Pre vs post billable rate for every cohort, ranked by decline.

    ``br_pre`` is NULL for a cohort absent before the hinge; NULL deltas
    rank last.
    """
    keys = list(keys)
    need = [k for k in keys if k != "os_major"] + (["os_version"] if "os_major" in keys else [])
    req = t.ad_requests.select("request_id", era("request_ts", hinge).alias("era"), *dict.fromkeys(need))
    x = t.impressions.filter(F.col("rendered")).select("request_id", "billable").join(req, "request_id")
    if "os_major" in keys:
        x = x.withColumn("os_major", os_major())
    pre, post = F.col("era") == ERA_PRE, F.col("era") == ERA_POST
    c = x.groupBy(*keys).agg(
        count_if(pre).alias("n_pre"),
        count_if(post).alias("n_post"),
        ratio(count_if(pre & F.col("billable")), count_if(pre)).alias("br_pre"),
        ratio(count_if(post & F.col("billable")), count_if(post)).alias("br_post"),
    )
    if min_n > 0:
        c = c.filter((F.col("n_pre") >= min_n) & (F.col("n_post") >= min_n))
    delta = F.col("br_post") - F.col("br_pre")
    return c.select(
        *keys, "n_pre", "n_post",
        dround("br_pre", 3).alias("br_pre"),
        dround("br_post", 3).alias("br_post"),
        dround(delta, 3).alias("delta"),
        F.rank().over(Window.orderBy(delta.asc_nulls_last())).cast("bigint").alias("decline_rank"),
    )


def control_diff(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    treated: str = "iOS",
    control: str = "Android",
    by: Sequence[str] = ("ad_format",),
) -> DataFrame:
    """Difference in differences. Per ``by`` group, the candidate-minus-base
    billable-rate change on the treated OS minus the same on the control OS."""
    by = list(by)
    x = rendered_post(t, hinge, F.col("os").isin(treated, control))
    cols = []
    for os_tag, os_v in (("treated", treated), ("control", control)):
        for v_tag, v in (("base", base), ("cand", cand)):
            on = (F.col("os") == os_v) & (F.col("sdk_version") == v)
            cols += [count_if(on).alias(f"n_{os_tag}_{v_tag}"), ratio(count_if(on & F.col("billable")), count_if(on)).alias(f"br_{os_tag}_{v_tag}")]
    c = x.groupBy(*by).agg(*cols)
    d_t = F.col("br_treated_cand") - F.col("br_treated_base")
    d_c = F.col("br_control_cand") - F.col("br_control_base")
    did = d_t - d_c
    return c.select(
        *by,
        "n_treated_base", "n_treated_cand", "n_control_base", "n_control_cand",
        *[dround(f"br_{a}_{b}", 3).alias(f"br_{a}_{b}") for a in ("treated", "control") for b in ("base", "cand")],
        dround(d_t, 3).alias("diff_treated"),
        dround(d_c, 3).alias("diff_control"),
        dround(did, 3).alias("did"),
        F.rank().over(Window.orderBy(did.asc_nulls_last())).cast("bigint").alias("did_rank"),
    )
