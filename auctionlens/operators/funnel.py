"""Funnel health: A01 daily funnel, D04 leak stage, D06 decline onset,
D07 rollout adoption, D13 publisher scope.

The funnel has three grains (bid, auction opportunity, impression). Each
fact is first reduced to one row per ``request_id`` (partial aggregation
before the shuffle), the three are joined on the request key (one
co-partitioned join, no fan-out), and only then grouped by day. Joining
bids to impressions first would multiply rows and corrupt every rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.functions.exprs import (
    count_if,
    dround,
    era,
    is_true,
    money,
    ratio,
    ts_lit,
)
from auctionlens.sources.schema import AdTables

REFERENCE_HINGE = "2026-05-20"
BASE, CAND = "8.1.0", "8.2.0"


def request_grain(t: AdTables, requests: DataFrame | None = None, extra: Sequence[Column | str] = ()) -> DataFrame:
    """One row per ad request with its bid and impression tallies.

    ``requests`` may be a filtered or enriched copy of ``t.ad_requests``;
    ``extra`` are additional request columns to carry (e.g. tier, era).
    """
    req = (requests if requests is not None else t.ad_requests).select(
        "request_id", F.to_date("request_ts").alias("d"), "request_ts", *extra
    )
    bids = t.bids.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_bids"),
        count_if(F.col("did_bid") == 1).alias("n_did_bid"),
        F.max("is_winner").alias("won"),
    )
    imps = t.impressions.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_imps"),
        count_if(F.col("rendered")).alias("n_rendered"),
        count_if(F.col("rendered") & F.col("billable")).alias("n_billable_rendered"),
        F.sum(money("revenue_usd")).alias("rev"),
    )
    return req.join(bids, "request_id", "left").join(imps, "request_id", "left")


SUM_COLUMNS = ("_bids", "_did", "_reqs", "_won", "_imps", "_rendered", "_billable", "_rev")


def funnel_sums(grain: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive funnel tallies per ``keys`` from :func:`request_grain` rows
    (revenue stays an exact decimal), so they can be re-grouped exactly."""
    return grain.groupBy(*keys).agg(
        F.sum("n_bids").alias("_bids"),
        F.sum("n_did_bid").alias("_did"),
        F.count(F.lit(1)).alias("_reqs"),
        count_if(F.col("won") == 1).alias("_won"),
        F.sum("n_imps").alias("_imps"),
        F.sum("n_rendered").alias("_rendered"),
        F.sum("n_billable_rendered").alias("_billable"),
        F.sum("rev").alias("_rev"),
    )


def regroup(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll :func:`funnel_sums` rows up to coarser ``keys`` (exact)."""
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUM_COLUMNS])


def rates_from_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Funnel rates from tallies. Groups with no bid or no impression are
    dropped, as the reference's inner join of the per-grain tables does."""
    agg = sums.filter((F.col("_bids") > 0) & (F.col("_imps") > 0))
    for k in keys:
        agg = agg.filter(F.col(k).isNotNull())
    return agg.select(
        *keys,
        ratio("_did", "_bids").alias("bid_rate"),
        ratio("_won", "_reqs").alias("win_rate"),
        ratio("_rendered", "_imps").alias("render_rate"),
        ratio("_billable", "_rendered").alias("billable_rate"),
        (ratio(F.col("_rev").cast("double"), "_rendered") * F.lit(1000.0)).alias("ecpm"),
    )


def funnel_rates(grain: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Funnel rates per ``keys`` from :func:`request_grain` rows."""
    return rates_from_sums(funnel_sums(grain, keys), keys)


UNKNOWN_SCOPE = "unknown"


def publisher_sums(
    t: AdTables, requests: DataFrame, keys: Sequence[str], scope: str = "tier", values: Sequence[str] | None = None
) -> DataFrame:
    """Funnel tallies per ``keys`` and a publisher attribute (``scope``: tier or
    region), optionally only of the given ``values``. Requests of publishers
    that are not in the dimension, or lack the attribute, are counted under
    ``unknown``.

    Tallies are first grouped by publisher at fact scale, and only that
    small result meets the publishers dimension; then it is rolled up by
    the attribute. No fact row is shuffled by publisher, so a hot publisher or a
    publishers table too large to broadcast costs nothing extra.
    """
    keys = list(keys)
    sums = funnel_sums(request_grain(t, requests, extra=["publisher_id", *[k for k in keys if k != "d"]]), ["publisher_id", *keys])
    pubs = t.dimension("publishers", "publisher_id", scope)
    if values is not None:
        pubs = pubs.filter(F.col(scope).isin(list(values)))
        sums = sums.join(pubs, "publisher_id")
    else:
        sums = sums.join(pubs, "publisher_id", "left").withColumn(scope, F.coalesce(scope, F.lit(UNKNOWN_SCOPE)))
    return regroup(sums, [scope, *keys])


def daily_funnel_raw(
    t: AdTables, ma_rows: int = 7, requests: DataFrame | None = None, tiers: Sequence[str] | None = None
) -> DataFrame:
    """Unrounded daily funnel with the trailing ``ma_rows``-row mean of eCPM.

    ``tiers`` limits it to publishers of those tiers (D13). The moving
    average is a global window over days: its single partition holds one
    row per calendar day, so it stays small at any data size.
    """
    if tiers is None:
        daily = funnel_rates(request_grain(t, requests), ["d"])
    else:
        sums = publisher_sums(t, requests if requests is not None else t.ad_requests, ["d"], "tier", tiers)
        daily = rates_from_sums(regroup(sums, ["d"]), ["d"])
    w = Window.orderBy(F.col("d").asc_nulls_last()).rowsBetween(-(ma_rows - 1), 0)
    return daily.withColumn("ecpm_ma", F.avg("ecpm").over(w))


def funnel_daily(
    t: AdTables, ma_rows: int = 7, requests: DataFrame | None = None, tiers: Sequence[str] | None = None
) -> DataFrame:
    """Daily bid / win / render / billable rate, eCPM and its moving average."""
    raw = daily_funnel_raw(t, ma_rows, requests, tiers)
    return raw.select(
        "d",
        dround("bid_rate", 3).alias("bid_rate"),
        dround("win_rate", 3).alias("win_rate"),
        dround("render_rate", 3).alias("render_rate"),
        dround("billable_rate", 3).alias("billable_rate"),
        dround("ecpm", 3).alias("ecpm"),
        dround("ecpm_ma", 3).alias("ecpm_7d_avg"),
    ).orderBy(F.col("d").asc_nulls_last())


def publisher_scope(t: AdTables, hinge: str = REFERENCE_HINGE, scope: str = "tier") -> DataFrame:
    """Funnel rates per publisher tier (or region) and era."""
    req = t.ad_requests.withColumn("era", era("request_ts", hinge))
    rates = rates_from_sums(publisher_sums(t, req, ["era"], scope), [scope, "era"])
    return rates.select(
        scope, "era", *[dround(c, 4).alias(c) for c in ("bid_rate", "win_rate", "render_rate", "billable_rate", "ecpm")]
    ).orderBy(F.col(scope).asc_nulls_last(), F.col("era").asc_nulls_last())


def _billing_signal(billing_type: Column, viewable: Column, video_completed: Column) -> Column:
    """The buyer's billing signal; NULL for an unknown billing type."""
    return (
        F.when(billing_type == "render", F.lit(True))
        .when(billing_type == "viewable", viewable)
        .when(billing_type == "complete", video_completed)
    )


def join_winning_bid(x: DataFrame, t: AdTables, cols: Sequence[str], how: str = "inner", hinge: str | None = None) -> DataFrame:
    """Attach winning-bid columns to impression rows (``bid_id = winning_bid_id``).

    When the tables declare ``winning_bid_in_request`` the join also matches
    ``request_id``: the same pairs, but tables bucketed by request_id join
    in place instead of shuffling the bids table on bid_id. ``hinge`` (for
    impressions already limited to post-hinge requests) lets the bids scan
    skip pre-hinge partitions.
    """
    keys = ["request_id", "winning_bid_id"] if t.winning_bid_in_request else ["winning_bid_id"]
    extra = ["request_id"] if t.winning_bid_in_request else []
    bids = t.since(t.bids, hinge) if hinge else t.bids
    bids = bids.select(F.col("bid_id").alias("winning_bid_id"), *extra, *[c for c in cols if c not in extra])
    return x.join(bids, keys, how)


def leak_stage(t: AdTables, hinge: str = REFERENCE_HINGE, keys: Sequence[str] = ("sdk_version", "os", "ad_format")) -> DataFrame:
    """First failed post-win gate per impression, counts and shares per cohort.

    Gates in order: rendered, latency within the bid TTL, billing signal
    present, billed. An impression's stage depends only on five flags and
    its buyer's billing type. Impressions are first counted per cohort,
    buyer and flag combination, and only those counts meet the buyers
    dimension. Left joins keep every impression, so the stage counts of a
    cohort sum to its impressions.
    """
    req = t.ad_requests.select("request_id", "request_ts", *keys)
    x = join_winning_bid(t.impressions.join(req, "request_id", "left"), t, ["bid_ttl_ms", "buyer_id"], "left")
    flags = {
        "f_rendered": is_true(F.col("rendered")),
        "f_expired": is_true(F.col("render_latency_ms") > F.col("bid_ttl_ms")),
        "f_viewable": is_true(F.col("viewable")),
        "f_completed": is_true(F.col("video_completed")),
        "f_billed": is_true(F.col("billable")),
    }
    gk = ["era", *keys]
    tallies = x.select(era("request_ts", hinge).alias("era"), *keys, "buyer_id", *[c.alias(n) for n, c in flags.items()]).groupBy(
        *gk, "buyer_id", *flags
    ).count()
    y = tallies.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id", "left")
    signal = _billing_signal(F.col("billing_type"), F.col("f_viewable"), F.col("f_completed"))
    stage = (
        F.when(~F.col("f_rendered"), F.lit("not_rendered"))
        .when(F.col("f_expired"), F.lit("expired"))
        .when(~is_true(signal), F.lit("signal_missing"))
        .when(F.col("f_billed"), F.lit("billed"))
        .otherwise(F.lit("unexplained"))
    )
    counts = y.groupBy(*gk, stage.alias("stage")).agg(F.sum("count").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*gk))
    return counts.select(
        *gk, "stage", F.col("count").cast("bigint").alias("n"), dround(ratio("count", total), 4).alias("share")
    )


def decline_onset(t: AdTables, hinge: str = REFERENCE_HINGE, drop: float = 0.10, run: int = 7, ma_rows: int = 7) -> DataFrame:
    """First day from the hinge on whose moving-average eCPM stays below
    ``(1 - drop)`` of the pre-hinge mean daily eCPM for ``run`` consecutive rows
    (complete runs only). Dips before the hinge are not the decline that the
    hinge brought; without a run after it the onset is NULL."""
    raw = daily_funnel_raw(t, ma_rows)
    hinge_d = F.to_date(ts_lit(hinge))
    order = F.col("d").asc_nulls_last()
    whole = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = Window.orderBy(order).rowsBetween(0, run - 1)
    x = raw.select(
        "d", "ecpm_ma",
        F.avg(F.when(F.col("d") < hinge_d, F.col("ecpm"))).over(whole).alias("baseline"),
    )
    below = F.when(F.col("ecpm_ma") < (1.0 - drop) * F.col("baseline"), 1).otherwise(0)
    x = x.withColumn("below", below)
    x = x.withColumn("run_ok", (F.min("below").over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == run))
    out = x.agg(
        F.max("baseline").alias("baseline_ecpm"),
        F.min(F.when(F.col("run_ok") & (F.col("d") >= hinge_d), F.col("d"))).alias("onset_day"),
    )
    return out.select(
        dround("baseline_ecpm", 4).alias("baseline_ecpm"),
        dround(F.col("baseline_ecpm") * (1.0 - drop), 4).alias("threshold_ecpm"),
        "onset_day",
        F.datediff("onset_day", hinge_d).cast("bigint").alias("days_after_hinge"),
    )


def rollout_adoption(t: AdTables, cand: str = CAND) -> DataFrame:
    """Daily candidate-version share of requests per OS, and its running share."""
    daily = t.ad_requests.groupBy("os", F.to_date("request_ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n_requests"),
        count_if(F.col("sdk_version") == cand).alias("n_cand"),
    )
    run = Window.partitionBy("os").orderBy(F.col("d").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        "os", "d",
        F.col("n_requests").cast("bigint").alias("n_requests"),
        "n_cand",
        dround(ratio("n_cand", "n_requests"), 4).alias("cand_share"),
        dround(ratio(F.sum("n_cand").over(run), F.sum("n_requests").over(run)), 4).alias("cum_cand_share"),
    )
