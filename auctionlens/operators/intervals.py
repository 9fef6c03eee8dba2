"""D05 / A09 with intervals: a Poisson bootstrap over days.

Impressions of one day are alike (campaigns, outages), so the day is the unit
that is drawn again: in a replicate each day counts Poisson(1) times. The number
is read from a hash of day and replicate, so a result depends neither on the
partitioning nor on the run. Impressions are tallied per day and cell once; only
the tallies are weighted, in all replicates at once, and added up. A cell has one
row a replicate after that, whatever the traffic.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.exprs import MONEY_TYPE, case_label, count_if, dround, is_true, money, ratio
from auctionlens.operators.cohorts import rendered_post
from auctionlens.operators.funnel import BASE, CAND, REFERENCE_HINGE
from auctionlens.operators.impact import default_impact_tallies
from auctionlens.operators.mechanism import _with_bid
from auctionlens.sources.schema import AdTables

REPLICATES = 200
LEVEL = 0.95


def poisson_weights(unit: Column, replicates: int) -> Column:
    """How often ``unit`` counts in each replicate, as an array: 1 in replicate 0,
    a Poisson(1) number in each further one, which is 32 bits of a hash of unit and
    replicate against the distribution's steps (numbers above 12 have no such bits).
    An array, so that each hash is computed once a row."""
    below, steps = 0.0, []
    for k in range(13):
        below += math.exp(-1.0) / math.factorial(k)
        steps.append(int(below * 2**32))
    text = lambda rep: F.concat(F.coalesce(unit.cast("string"), F.lit("")), F.lit(":"), rep.cast("string"))
    bits = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda rep: F.conv(F.substring(F.md5(text(rep).cast("binary")), 1, 8), 16, 10).cast("bigint"))
    levels = F.array(*[F.lit(s).cast("bigint") for s in steps])
    return F.concat(F.array(F.lit(1)), F.transform(bits, lambda u: F.size(F.filter(levels, lambda s: s <= u))))


def replicated(tallies: DataFrame, keys: Sequence[str], unit: str, sums: Sequence[str], replicates: int = REPLICATES) -> DataFrame:
    """Per ``keys`` and replicate ``rep`` the weighted ``sums``; replicate 0 has
    every unit once. Sums are counts or decimals, so they are exact. A key whose
    units all have weight 0 has no row in that replicate."""
    if replicates < 1:
        raise ValueError("replicates must be at least 1")
    x = tallies.select(*keys, *sums, F.posexplode(poisson_weights(F.col(unit), replicates)).alias("rep", "_w")).filter("_w > 0")

    def weighted(name: str) -> Column:
        if x.schema[name].dataType.typeName() == "decimal":  # 34 + 3 + 1 digits: no decimal is lost
            return F.sum(F.col(name).cast("decimal(34,12)") * F.col("_w").cast("decimal(3,0)"))
        return F.sum(F.col(name) * F.col("_w")).cast("bigint")

    return x.groupBy(*keys, "rep").agg(*[weighted(s).alias(s) for s in sums])


def bounds(reps: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], carry: Sequence[str] = (), level: float = LEVEL) -> DataFrame:
    """Per ``keys``: of each statistic the value of replicate 0 (its name), the
    ends of the central ``level`` of the others (``_lo``, ``_hi``: order statistics)
    and how many replicates define it (``_reps``); ``carry`` as of replicate 0."""
    if not 0.0 < level < 1.0:
        raise ValueError("level must be between 0 and 1")
    x = reps.select(*keys, "rep", *carry, *[c.alias(n) for n, c in stats.items()])
    own = lambda n: F.max(F.when(F.col("rep") == 0, F.col(n))).alias(n)
    drawn = lambda n: F.sort_array(F.collect_list(F.when(F.col("rep") > 0, F.col(n)))).alias(f"_{n}")
    g = x.groupBy(*keys).agg(*[own(n) for n in (*carry, *stats)], *[drawn(n) for n in stats])
    cols = []
    for n in stats:
        m = F.size(f"_{n}")
        at = lambda p, n=n, m=m: F.get(f"_{n}", F.greatest(F.ceil(m * F.lit(p)), F.lit(1)).cast("int") - 1)
        cols += [at((1.0 - level) / 2).alias(f"{n}_lo"), at((1.0 + level) / 2).alias(f"{n}_hi"), m.cast("bigint").alias(f"{n}_reps")]
    return g.select(*keys, *carry, *stats, *cols)


def control_diff_intervals(
    t: AdTables, hinge: str = REFERENCE_HINGE, base: str = BASE, cand: str = CAND, treated: str = "iOS", control: str = "Android",
    by: Sequence[str] = ("ad_format",), replicates: int = REPLICATES, level: float = LEVEL,
) -> DataFrame:
    """D05 with an interval: the difference in differences of the billable rate
    per ``by`` group, its bounds over ``replicates`` draws of days, and ``clear``:
    the interval is on one side of zero. A draw without rows in one of the four
    cells defines no difference and is not counted in ``n_replicates``."""
    by = list(by)
    x = rendered_post(t, hinge, F.col("os").isin(treated, control) & F.col("sdk_version").isin(base, cand))
    cells = [(f"{a}_{b}", (F.col("os") == o) & (F.col("sdk_version") == v)) for a, o in (("treated", treated), ("control", control)) for b, v in (("base", base), ("cand", cand))]
    names = [f"{p}_{c}" for c, _ in cells for p in ("n", "k")]
    aggs = [count_if(on & more).alias(f"{p}_{c}") for c, on in cells for p, more in (("n", F.lit(True)), ("k", is_true("billable")))]
    tallies = x.groupBy(*by, F.to_date("request_ts").alias("_d")).agg(*aggs)
    rate = {c: ratio(f"k_{c}", f"n_{c}") for c, _ in cells}
    did = (rate["treated_cand"] - rate["treated_base"]) - (rate["control_cand"] - rate["control_base"])
    sizes = [f"n_{c}" for c, _ in cells]
    b = bounds(replicated(tallies, by, "_d", names, replicates), by, {"did": did}, sizes, level)
    return b.select(
        *by, *sizes,
        *[dround(c, 3).alias(c) for c in ("did", "did_lo", "did_hi")],
        F.col("did_reps").alias("n_replicates"),
        F.coalesce((F.col("did_lo") > 0) | (F.col("did_hi") < 0), F.lit(False)).alias("clear"),
    )


def impact_intervals(
    t: AdTables, hinge: str = REFERENCE_HINGE, base: str = BASE, cand: str = CAND, cases: Sequence[tuple[str, Column]] | None = None,
    prefilter: Column | None = None, replicates: int = REPLICATES, level: float = LEVEL,
) -> DataFrame:
    """A09 with intervals: billable impressions and dollars lost per cohort
    against the base version's rate and price, with bounds over ``replicates``
    draws of days. A gain is a negative loss here (it is not cut at 0), so that
    ``clear`` can say whether a loss is more than chance. ``cases`` and
    ``prefilter`` as in the plain operator."""
    sums = ["nc", "bc", "nb", "bb", "rb"]
    if cases is None:
        x = default_impact_tallies(t, hinge, base, cand, with_days=True)
    else:
        x = _with_bid(rendered_post(t, hinge, prefilter), t, ["buyer_id"], hinge)
        x = x.join(t.dimension("buyers", "buyer_id", "billing_type"), "buyer_id").withColumn("cohort", case_label(cases)).filter(F.col("cohort").isNotNull())
        is_b, is_c, bill = F.col("sdk_version") == base, F.col("sdk_version") == cand, is_true("billable")
        x = x.groupBy("cohort", F.to_date("request_ts").alias("_d")).agg(
            count_if(is_c).alias("nc"), count_if(is_c & bill).alias("bc"), count_if(is_b).alias("nb"), count_if(is_b & bill).alias("bb"),
            F.sum(F.when(is_b & bill, money("revenue_usd")).otherwise(F.lit(0).cast(MONEY_TYPE))).alias("rb"),
        )
    days = x.groupBy("cohort", "_d").agg(*[F.sum(c).alias(c) for c in sums])
    lost = ratio("bb", "nb") * F.col("nc") - F.col("bc")
    usd = lost * ratio(F.col("rb").cast("double"), "bb")
    b = bounds(replicated(days, ["cohort"], "_d", sums, replicates), ["cohort"], {"lost": lost, "usd": usd}, ["nc"], level)
    return b.select(
        "cohort", F.col("nc").alias("rendered_cand"),
        *[dround(f"lost{e}", 2).alias(f"lost_billable_imps{e}") for e in ("", "_lo", "_hi")],
        *[dround(f"usd{e}", 4).alias(f"lost_revenue_usd{e}") for e in ("", "_lo", "_hi")],
        F.col("lost_reps").alias("n_replicates"),
        F.coalesce(F.col("lost_lo") > 0, F.lit(False)).alias("clear"),
    )
