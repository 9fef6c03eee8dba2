"""D06 by data: the change points of a series, by penalised optimal segmentation.

Killick, Fearnhead, Eckley, "Optimal Detection of Changepoints With a Linear
Computational Cost" (2012). A series is cut into segments of constant mean so
that the squared deviations plus a penalty per segment are least, over all
segmentations: dynamic programming over prefix sums, which drops a start as soon
as it can never be the best again. The programme is a fold over arrays in the
JVM (higher-order functions); a series (cohort) has a value a bucket, so an array
is as long as the calendar, and cohorts run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.functions.exprs import dround, ratio, ts_lit
from auctionlens.operators.funnel import REFERENCE_HINGE, funnel_sums, regroup, request_grain
from auctionlens.sources.schema import AdTables

PENALTY = 3.0


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _prefix_sums(x: Column) -> Column:
    return F.aggregate(x, F.array(F.lit(0.0)), lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)))


def segment_starts(x: Column, penalty: float = PENALTY) -> Column:
    """Starts of the segments of an array of doubles, as an array (0 first).

    The penalty of a segment is ``penalty`` * ln(n) times the noise, half the
    mean squared difference of neighbours. Of equally good last segments the one
    that begins first is taken; fewer than three values are one segment."""
    n = F.size(x)
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.pow(x[i] - x[i - 1], F.lit(2.0)))
    noise = F.aggregate(steps, F.lit(0.0), lambda a, v: a + v) / (n - 1) / 2
    given = F.struct(_prefix_sums(x).alias("s1"), _prefix_sums(F.transform(x, lambda v: v * v)).alias("s2"), (F.lit(penalty) * F.ln(n.cast("double")) * noise).alias("beta"))

    def solved(g: Column) -> Column:
        def cost(f: Column, s: Column, t: Column) -> Column:
            d = g["s1"][t] - g["s1"][s]
            return f[s] + F.greatest(g["s2"][t] - g["s2"][s] - d * d / (t - s), F.lit(0.0))

        def step(acc: Column, t: Column) -> Column:
            costs = F.transform(acc["starts"], lambda s: F.struct(cost(acc["f"], s, t).alias("c"), s.alias("s")))

            def chosen(costs: Column, best: Column) -> Column:
                total = best["c"] + g["beta"]  # a start that costs more now is never the best again
                live = F.transform(F.filter(costs, lambda c: c["c"] <= total), lambda c: c["s"])
                return F.struct(F.concat(acc["f"], F.array(total)).alias("f"), F.concat(acc["prev"], F.array(best["s"])).alias("prev"), F.concat(live, F.array(t)).alias("starts"))

            return _let(costs, lambda costs: _let(F.array_min(costs), lambda best: chosen(costs, best)))

        begin = F.struct(F.array(-g["beta"]).alias("f"), F.array(F.lit(0)).alias("prev"), F.array(F.lit(0)).alias("starts"))
        return F.aggregate(F.sequence(F.lit(1), n), begin, step, lambda acc: acc["prev"])

    def traced(prev: Column) -> Column:
        path = F.aggregate(
            F.sequence(F.lit(1), n), F.array(n), lambda path, _: F.when(F.element_at(path, -1) > 0, F.concat(path, F.array(prev[F.element_at(path, -1)]))).otherwise(path)
        )
        return F.sort_array(F.slice(path, 2, F.size(path) - 1))

    return F.when(n < 3, F.array(F.lit(0))).otherwise(_let(_let(given, solved), traced))


def with_segments(series: DataFrame, keys: Sequence[str], order: str, value: str, penalty: float = PENALTY) -> DataFrame:
    """``series`` with ``segment`` (from 1) by ``keys``; a row without a value
    belongs to its predecessor's segment (the first ones to the first). A key's
    values meet in one array, which is as long as the calendar."""
    keys = list(keys)
    known = series.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_x"))
    starts = segment_starts(F.transform("_x", lambda r: r["v"]), penalty)
    cuts = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.transform(starts, lambda i: F.col("_x")[i]["o"]).alias("_cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = series.join(cuts, same, "left").select(*series.columns, "_cuts")
    passed = F.size(F.filter("_cuts", lambda c: c <= F.col(order)))
    return joined.withColumn("segment", F.greatest(F.lit(1), F.coalesce(passed, F.lit(1))).cast("bigint")).drop("_cuts")


def ecpm_segments(
    t: AdTables, hinge: str = REFERENCE_HINGE, keys: Sequence[str] = (), bucket: str = "1 day", penalty: float = PENALTY
) -> DataFrame:
    """The segments of constant eCPM of each cohort (``keys``: columns of
    the requests; none is all traffic), by buckets of ``bucket``.

    Per segment: first and last bucket, their number, eCPM (revenue over
    rendered impressions of the segment, exact), its change from the segment
    before, and ``onset``: the segment from the hinge's bucket on with the
    largest fall, if any falls. Buckets without a rendered impression have no
    eCPM and do not decide."""
    keys = list(keys)
    grain = request_grain(t, t.ad_requests, extra=keys)
    w = F.window(F.col("d").cast("timestamp_ntz"), bucket)
    sums = funnel_sums(grain, ["d", *keys]).filter("d is not null").withColumn("w", w)
    sums = regroup(sums, ["w", *keys]).select(F.lit(0).alias("_all"), *keys, F.col("w.start").alias("b"), F.col("w.end").alias("b_end"), "_rev", "_rendered")
    series = sums.withColumn("ecpm", ratio(F.col("_rev").cast("double"), "_rendered") * 1000.0)
    cut = with_segments(series, ["_all", *keys], "b", "ecpm", penalty)
    seg = cut.groupBy(*keys, "segment").agg(
        F.min("b").alias("first_bucket"), F.max("b").alias("last_bucket"), F.min("b_end").alias("first_end"),
        F.count(F.lit(1)).alias("n_buckets"), F.sum("_rev").alias("r"), F.sum("_rendered").alias("n"),
    )
    seg = seg.withColumn("e", ratio(F.col("r").cast("double"), "n") * 1000.0)
    by = Window.partitionBy(*keys).orderBy(F.col("segment").asc_nulls_last())
    seg = seg.withColumn("change", F.col("e") - F.lag("e").over(by))
    fall = F.when((F.col("first_end") > ts_lit(hinge)) & (F.col("change") < 0), F.col("change"))
    least = F.min(fall).over(Window.partitionBy(*keys))
    return seg.withColumn("onset", F.coalesce(fall == least, F.lit(False))).select(
        *keys, "segment", "first_bucket", "last_bucket", "n_buckets", dround("e", 4).alias("ecpm"), dround("change", 4).alias("change"), "onset"
    )
