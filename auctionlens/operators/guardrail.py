"""The win-to-billable guardrail in batch.

Win-to-billable = billable impressions / won impressions (every impression
is a won auction), per event-time window and cohort, for the candidate and
the incumbent SDK version side by side. ``guardrail_windows`` is written
once and used by both the batch operator and the Structured Streaming job
(``auctionlens.streaming.guardrail``): it only uses a time ``window`` group
and conditional aggregates, which a streaming aggregation supports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.exprs import count_if, dround, ratio, ts_lit
from auctionlens.operators.funnel import BASE, CAND, REFERENCE_HINGE, join_winning_bid
from auctionlens.sources.schema import AdTables

GUARDRAIL_KEYS = ("os_version", "ad_format")


def won_impressions(t: AdTables, keys: Sequence[str] = GUARDRAIL_KEYS, with_buyer: bool = False) -> DataFrame:
    """Won impressions with event time ``ts``, version, cohort keys, billable
    flag and render latency (and ``buyer_id`` with ``with_buyer``).
    ``billing_type`` may be a key: the buyer is then attached through the
    winning bid (a viewable-only fault is diluted when buyers of every
    billing type share one cohort)."""
    req_keys = [k for k in keys if k != "billing_type"]
    req = t.ad_requests.select("request_id", F.col("request_ts").alias("ts"), "sdk_version", *req_keys)
    x = t.impressions.select("impression_id", "request_id", "winning_bid_id", "billable", "render_latency_ms").join(req, "request_id")
    if with_buyer or "billing_type" in keys:
        x = join_winning_bid(x, t, ["buyer_id"])
    if "billing_type" in keys:
        x = x.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id")
    extra = ["buyer_id"] if with_buyer else []
    return x.select("impression_id", "request_id", "ts", "sdk_version", *keys, *extra, "billable", "render_latency_ms")


TALLIES = ("n_base", "n_cand", "b_base", "b_cand")


def guardrail_tallies(
    df: DataFrame,
    base: str = BASE,
    cand: str = CAND,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    window: str = "1 day",
    slide: str | None = None,
    ts_col: str = "ts",
    latency_probs: Sequence[float] = (),
    accuracy: int = 10000,
) -> DataFrame:
    """Per event-time window ``w`` and cohort: additive counts of each
    version's won and billed impressions (plus optional approximate
    candidate latency percentiles, which are not additive)."""
    w = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
    is_b, is_c, bill = F.col("sdk_version") == base, F.col("sdk_version") == cand, F.col("billable")
    lat = [
        F.percentile_approx(F.when(is_c, F.col("render_latency_ms")), p, accuracy).alias(f"p{int(round(p * 100))}_latency_cand")
        for p in latency_probs
    ]
    return df.groupBy(w.alias("w"), *keys).agg(
        count_if(is_b).alias("n_base"),
        count_if(is_c).alias("n_cand"),
        count_if(is_b & bill).alias("b_base"),
        count_if(is_c & bill).alias("b_cand"),
        *lat,
    )


def guardrail_finish(
    g: DataFrame,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    min_n: int = 15,
    tol: float = 0.3,
    z_min: float | None = None,
    latency_probs: Sequence[float] = (),
) -> DataFrame:
    """Conversions, the pooled two-proportion z-score of the drop and the
    alert flag from :func:`guardrail_tallies` rows."""
    conv_b, conv_c = ratio("b_base", "n_base"), ratio("b_cand", "n_cand")
    pooled = ratio(F.col("b_base") + F.col("b_cand"), F.col("n_base") + F.col("n_cand"))
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (ratio(F.lit(1.0), "n_base") + ratio(F.lit(1.0), "n_cand")))
    z = F.try_divide(conv_b - conv_c, F.nullif(se, F.lit(0.0)))
    alert = (F.col("n_base") >= min_n) & (F.col("n_cand") >= min_n) & (conv_c < conv_b - F.lit(tol))
    if z_min is not None:
        alert = alert & (z >= F.lit(float(z_min)))
    return g.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        *keys,
        "n_base", "n_cand",
        dround(conv_b, 4).alias("conv_base"),
        dround(conv_c, 4).alias("conv_cand"),
        dround(z, 3).alias("z_score"),
        F.coalesce(alert, F.lit(False)).alias("alert"),
        *[f"p{int(round(p * 100))}_latency_cand" for p in latency_probs],
    )


def guardrail_windows(
    df: DataFrame,
    base: str = BASE,
    cand: str = CAND,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    window: str = "1 day",
    slide: str | None = None,
    min_n: int = 15,
    tol: float = 0.3,
    ts_col: str = "ts",
    z_min: float | None = None,
    latency_probs: Sequence[float] = (),
    accuracy: int = 10000,
) -> DataFrame:
    """Per window and cohort: volume and conversion of each version, the pooled
    two-proportion z-score of the drop, and the alert flag
    ``n_base >= min_n AND n_cand >= min_n AND conv_cand < conv_base - tol``
    (``AND z_score >= z_min`` when ``z_min`` is given).

    Works on a batch or a streaming DataFrame with columns ``ts_col``,
    ``sdk_version``, ``billable`` and ``keys``; ``latency_probs`` adds
    approximate candidate render-latency percentiles (fixed-size state).
    """
    g = guardrail_tallies(df, base, cand, keys, window, slide, ts_col, latency_probs, accuracy)
    return guardrail_finish(g, keys, min_n, tol, z_min, latency_probs)


def guardrail_batch(t: AdTables, keys: Sequence[str] = GUARDRAIL_KEYS, **kw) -> DataFrame:
    """D11 over the whole history: every window x cohort row with its flag.

    With ``billing_type`` as a key, windows are tallied per buyer first and
    only those tallies meet the buyers dimension, then are rolled up by
    billing type (counts are additive; latency percentiles are not, so
    with ``latency_probs`` the buyer is attached row by row instead).
    """
    keys = list(keys)
    if "billing_type" not in keys or kw.get("latency_probs"):
        return guardrail_windows(won_impressions(t, keys), keys=keys, **kw)
    finish = {k: kw.pop(k) for k in ("min_n", "tol", "z_min") if k in kw}
    inner = [k for k in keys if k != "billing_type"]
    g = guardrail_tallies(won_impressions(t, inner, with_buyer=True), keys=[*inner, "buyer_id"], **kw)
    g = g.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id")
    g = g.groupBy("w", *keys).agg(*[F.sum(c).alias(c) for c in TALLIES])
    return guardrail_finish(g, keys, **finish)


def first_alerts(windows: DataFrame, hinge: str = REFERENCE_HINGE, keys: Sequence[str] = GUARDRAIL_KEYS) -> DataFrame:
    """Per cohort with at least one alert: the first alerting window, the hours
    from the hinge to its close (when the alert could fire), alert count."""
    a = windows.filter("alert").groupBy(*keys).agg(
        F.min("window_start").alias("first_alert_start"),
        F.min("window_end").alias("first_alert_end"),
        F.count(F.lit(1)).alias("n_alert_windows"),
    )
    return a.select(
        *keys, "first_alert_start", "first_alert_end",
        F.timestamp_diff("HOUR", ts_lit(hinge), F.col("first_alert_end")).cast("bigint").alias("hours_after_hinge"),
        "n_alert_windows",
    )


def guardrail_first_alert(t: AdTables, hinge: str = REFERENCE_HINGE, keys: Sequence[str] = GUARDRAIL_KEYS, **kw) -> DataFrame:
    """D11 summary: when each cohort would first have alerted."""
    return first_alerts(guardrail_batch(t, keys=keys, **kw), hinge, keys)


def guardrail_versions(
    t: AdTables,
    incumbent: str = BASE,
    keys: Sequence[str] = GUARDRAIL_KEYS,
    window: str = "1 day",
    slide: str | None = None,
    min_n: int = 15,
    tol: float = 0.3,
    z_min: float | None = 3.0,
) -> DataFrame:
    """D11 for any number of versions: one row per window, cohort and version
    other than the declared ``incumbent``, compared with the incumbent's traffic
    of the same window and cohort. Tallies are made per version (and buyer, if
    ``billing_type`` is a key) at fact scale; only they are joined."""
    keys = list(keys)
    inner = [k for k in keys if k != "billing_type"]
    buyer = ["buyer_id"] if "billing_type" in keys else []
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = won_impressions(t, inner, with_buyer=bool(buyer)).groupBy(w.alias("w"), *inner, *buyer, "sdk_version").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("billable")).alias("b")
    )
    if buyer:
        g = g.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id")
        g = g.groupBy("w", *keys, "sdk_version").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    old = g.filter(F.col("sdk_version") == incumbent).select("w", *keys, F.col("n").alias("n_base"), F.col("b").alias("b_base"))
    new = g.filter(F.col("sdk_version") != incumbent).select("w", *keys, "sdk_version", F.col("n").alias("n_cand"), F.col("b").alias("b_cand"))
    x = new.join(old, ["w", *keys], "left")
    x = x.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in TALLIES})
    return guardrail_finish(x, [*keys, "sdk_version"], min_n, tol, z_min)
