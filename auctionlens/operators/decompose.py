"""eCPM decomposition: A02 price x fill by era, A03 geo mix control,
D02 log attribution, D03 mix standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.functions.exprs import ERA_POST, ERA_PRE, count_if, dround, era, money, ratio
from auctionlens.operators.funnel import REFERENCE_HINGE
from auctionlens.sources.schema import AdTables

# The low-eCPM country set and the 2B scope labels.
LOW_ECPM_COUNTRIES = ("IN", "ID", "BR")
ALL_GEOS_LABEL = "All geos (blended)"


def focus_label(focus: str) -> str:
    return f"{focus} only (geo held constant)"


def _imps_with_request(t: AdTables, hinge: str, request_cols: Sequence[str] = ()) -> DataFrame:
    req = t.ad_requests.select("request_id", era("request_ts", hinge).alias("era"), *request_cols)
    imps = t.impressions.select("request_id", "rendered", "billable", "revenue_usd")
    return imps.join(req, "request_id")


def _era_totals(t: AdTables, hinge: str) -> DataFrame:
    """Per era: billable and rendered counts, revenue; and the three ratios."""
    agg = _imps_with_request(t, hinge).groupBy("era").agg(
        count_if(F.col("billable")).alias("n_billable"),
        count_if(F.col("rendered")).alias("n_rendered"),
        F.sum(money("revenue_usd")).cast("double").alias("rev"),
    )
    return agg.select(
        "era", "n_billable", "n_rendered", "rev",
        ratio("n_billable", "n_rendered").alias("billable_rate"),
        (ratio("rev", "n_billable") * 1000.0).alias("price_cpm"),
        (ratio("rev", "n_rendered") * 1000.0).alias("ecpm"),
    )


def ecpm_decomposition(t: AdTables, hinge: str = REFERENCE_HINGE) -> DataFrame:
    """eCPM = billable_rate x price_cpm per era, with era-over-era % change.

    The LAG window runs over one row per era.
    """
    p = _era_totals(t, hinge)
    w = Window.orderBy(F.col("era").asc_nulls_last())

    def pct(c: str):
        return dround(F.lit(100.0) * (F.try_divide(F.col(c), F.lag(c).over(w)) - F.lit(1.0)), 1)

    return p.select(
        "era",
        dround("billable_rate", 3).alias("billable_rate"),
        dround("price_cpm", 3).alias("price_cpm"),
        dround("ecpm", 3).alias("ecpm"),
        pct("billable_rate").alias("billable_rate_pct_chg"),
        pct("price_cpm").alias("price_pct_chg"),
        pct("ecpm").alias("ecpm_pct_chg"),
    ).orderBy(F.col("era").asc_nulls_last())


def geo_mix_control(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    focus: str = "US",
    low_set: Sequence[str] = LOW_ECPM_COUNTRIES,
    scope_mode: str = "partition",
) -> DataFrame:
    """Price per billable impression and low-eCPM-country share per scope and era.

    ``scope_mode='partition'`` reproduces the reference: the blended label
    covers only rows outside the focus country. ``'overlap'`` makes the
    blended scope a true blend (focus rows counted in both scopes); each
    row fans out to at most two scopes.
    """
    x = _imps_with_request(t, hinge, ["country"]).filter(F.col("country").isNotNull())
    is_focus = F.col("country") == F.lit(focus)
    if scope_mode == "partition":
        scope = F.when(is_focus, F.lit(focus_label(focus))).otherwise(F.lit(ALL_GEOS_LABEL))
        x = x.withColumn("scope", scope)
    elif scope_mode == "overlap":
        scopes = F.when(is_focus, F.array(F.lit(focus_label(focus)), F.lit(ALL_GEOS_LABEL))).otherwise(
            F.array(F.lit(ALL_GEOS_LABEL))
        )
        x = x.withColumn("scope", F.explode(scopes))
    else:
        raise ValueError(f"scope_mode must be 'partition' or 'overlap', not {scope_mode!r}")
    agg = x.groupBy("scope", "era").agg(
        F.sum(money("revenue_usd")).cast("double").alias("rev"),
        count_if(F.col("billable")).alias("n_billable"),
        count_if(F.col("country").isin(list(low_set))).alias("n_low"),
        F.count(F.lit(1)).alias("n"),
    )
    return agg.select(
        "scope", "era",
        dround(ratio("rev", "n_billable") * 1000.0, 3).alias("price_cpm"),
        dround(ratio("n_low", "n"), 3).alias("low_ecpm_geo_share"),
    ).orderBy(F.col("scope").asc_nulls_last(), F.col("era").asc_nulls_last())


def ecpm_attribution(t: AdTables, hinge: str = REFERENCE_HINGE) -> DataFrame:
    """Share of the eCPM change due to billable rate vs price (log shares).

    ``ln(e1/e0) = ln(br1/br0) + ln(p1/p0)``, so the two shares sum to 1.
    The era rows are pivoted with a global conditional aggregate (two rows).
    """
    p = _era_totals(t, hinge)

    def at(c: str, e: str):
        return F.max(F.when(F.col("era") == e, F.col(c)))

    one = p.agg(
        *[at(c, e).alias(f"{c}_{tag}") for c in ("billable_rate", "price_cpm", "ecpm") for e, tag in ((ERA_PRE, "pre"), (ERA_POST, "post"))]
    )

    def log_ratio(c: str):
        return F.log(F.try_divide(F.col(f"{c}_post"), F.col(f"{c}_pre")))

    le = log_ratio("ecpm")
    return one.select(
        dround("billable_rate_pre", 4).alias("br_pre"),
        dround("billable_rate_post", 4).alias("br_post"),
        dround("price_cpm_pre", 4).alias("price_pre"),
        dround("price_cpm_post", 4).alias("price_post"),
        dround("ecpm_pre", 4).alias("ecpm_pre"),
        dround("ecpm_post", 4).alias("ecpm_post"),
        dround(le, 4).alias("ecpm_log_change"),
        dround(F.try_divide(log_ratio("billable_rate"), le), 4).alias("billable_share"),
        dround(F.try_divide(log_ratio("price_cpm"), le), 4).alias("price_share"),
    )


def mix_standardized(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    strata: Sequence[str] = ("country", "os", "ad_format"),
) -> DataFrame:
    """Split the pre->post change of eCPM and billable rate into a
    within-stratum part and a traffic-mix part (direct standardisation).

    With weights ``w`` (rendered share per stratum) and stratum rates ``r``:
    ``within = sum w0 (r1 - r0)``, ``mix = sum (w1 - w0) r1``,
    ``within + mix = total_post - total_pre``. A stratum seen in one era
    only keeps its rate in the other (no within change). Everything
    reduces to sums over strata, so the plan is one aggregate per stratum
    and one global aggregate, with no join and no window.
    """
    x = _imps_with_request(t, hinge, list(strata))
    pre, post = F.col("era") == ERA_PRE, F.col("era") == ERA_POST
    rendered = F.col("rendered")
    s = x.groupBy(*strata).agg(
        count_if(pre & rendered).alias("n0"),
        count_if(post & rendered).alias("n1"),
        count_if(pre & rendered & F.col("billable")).alias("b0"),
        count_if(post & rendered & F.col("billable")).alias("b1"),
        F.sum(F.when(pre, money("revenue_usd"))).cast("double").alias("v0"),
        F.sum(F.when(post, money("revenue_usd"))).cast("double").alias("v1"),
    )
    metrics = {
        "ecpm": (ratio("v0", "n0") * 1000.0, ratio("v1", "n1") * 1000.0),
        "billable_rate": (ratio("b0", "n0"), ratio("b1", "n1")),
    }
    cols = [F.sum("n0").alias("N0"), F.sum("n1").alias("N1")]
    for m, (r0, r1) in metrics.items():
        r0f = F.coalesce(r0, r1, F.lit(0.0))
        r1f = F.coalesce(r1, r0, F.lit(0.0))
        cols += [
            F.sum(F.col("n0") * r0f).alias(f"{m}_a"),  # sum n0 r0
            F.sum(F.col("n1") * r1f).alias(f"{m}_b"),  # sum n1 r1
            F.sum(F.col("n0") * r1f).alias(f"{m}_c"),  # sum n0 r1
        ]
    g = s.agg(*cols)
    rows = []
    for m in metrics:
        pre_t = F.try_divide(F.col(f"{m}_a"), F.col("N0").cast("double"))
        post_t = F.try_divide(F.col(f"{m}_b"), F.col("N1").cast("double"))
        cross = F.try_divide(F.col(f"{m}_c"), F.col("N0").cast("double"))
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                dround(pre_t, 4).alias("total_pre"),
                dround(post_t, 4).alias("total_post"),
                dround(post_t - pre_t, 4).alias("total_change"),
                dround(cross - pre_t, 4).alias("within"),
                dround(post_t - cross, 4).alias("mix"),
            )
        )
    return g.select(F.inline(F.array(*rows)))


def mix_shapley(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    variables: Sequence[str] = ("country", "os", "os_version", "ad_format"),
) -> DataFrame:
    """D03 for several mix variables at once: what each contributes to the mix
    effect of ``mix_standardized`` over the same strata, whatever their order.

    ``g(S)`` is the post total with the traffic shares of the variables in ``S`` put
    back to those before the hinge, and the others as they are after it, given those in
    ``S``: over the groups of ``S``, the pre share times the post rate. So
    ``g({})`` is the post total and ``g({}) - g(all)`` the mix effect. A variable's
    part is its Shapley value: what putting it back takes off ``g``, averaged over
    all orders of the variables. ``within`` and the parts add up to the change.
    A group without post rows keeps its pre rate.

    Impressions are tallied by all variables once; the cube is taken over those
    tallies, and its ``2 ** len(variables)`` totals are weighted in one aggregate.
    """
    variables = list(variables)
    d = len(variables)
    if not 1 <= d <= 10:
        raise ValueError(f"from 1 to 10 variables, not {d}")
    x = _imps_with_request(t, hinge, variables)
    pre, post = F.col("era") == ERA_PRE, F.col("era") == ERA_POST
    rendered = F.col("rendered")
    sums = {
        "n0": count_if(pre & rendered), "n1": count_if(post & rendered),
        "b0": count_if(pre & rendered & F.col("billable")), "b1": count_if(post & rendered & F.col("billable")),
        "v0": F.sum(F.when(pre, money("revenue_usd"))), "v1": F.sum(F.when(post, money("revenue_usd"))),
    }
    cells = x.groupBy(*variables).agg(*[e.alias(c) for c, e in sums.items()])
    cube = cells.cube(*variables).agg(*[F.sum(c).alias(c) for c in sums], F.grouping_id().alias("_gid"))
    rates = {"ecpm": ("v", 1000.0), "billable_rate": ("b", 1.0)}
    totals = []
    for m, (c, unit) in rates.items():
        r0, r1 = ratio(f"{c}0", "n0") * unit, ratio(f"{c}1", "n1") * unit
        totals.append(ratio(F.sum(F.col("n0") * F.coalesce(r1, r0, F.lit(0.0))), F.sum("n0")).alias(f"{m}_g"))
        # the row of no variable holds the totals themselves
        totals += [F.max(r0).alias(f"{m}_pre"), F.max(r1).alias(f"{m}_post")]
    g = cube.groupBy("_gid").agg(*totals)
    none = 2**d - 1  # a bit of the grouping id is set for a variable left out

    def weight(i: int, gid: int) -> float:
        left_out = gid >> (d - 1 - i) & 1
        size = d - bin(gid).count("1")
        others = size if left_out else size - 1
        w = factorial(others) * factorial(d - 1 - others) / factorial(d)
        return w if left_out else -w

    cols = []
    for m in rates:
        cols += [F.max(F.when(F.col("_gid") == none, F.col(f"{m}_{e}"))).alias(f"{m}_{e}") for e in ("pre", "post")]
        cols.append(F.max(F.when(F.col("_gid") == 0, F.col(f"{m}_g"))).alias(f"{m}_cross"))
        for i, v in enumerate(variables):
            weights = F.array(*[F.lit(weight(i, gid)) for gid in range(2**d)])
            g_of_none = F.when(F.col("_gid") == none, F.col(f"{m}_post")).otherwise(F.col(f"{m}_g"))
            cols.append(F.sum(F.element_at(weights, F.col("_gid").cast("int") + 1) * g_of_none).alias(f"{m}_of_{v}"))
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            dround(f"{m}_pre", 4).alias("total_pre"), dround(f"{m}_post", 4).alias("total_post"),
            dround(F.col(f"{m}_post") - F.col(f"{m}_pre"), 4).alias("total_change"),
            dround(F.col(f"{m}_cross") - F.col(f"{m}_pre"), 4).alias("within"),
            dround(F.col(f"{m}_post") - F.col(f"{m}_cross"), 4).alias("mix"),
            *[dround(f"{m}_of_{v}", 4).alias(f"mix_{v}") for v in variables],
        )
        for m in rates
    ]
    return g.agg(*cols).select(F.inline(F.array(*rows)))
