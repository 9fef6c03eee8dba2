"""D07 as a curve: the share of a version that only rises, fitted to the days.

The least-squares nondecreasing share (weighted by requests) is found by pooling
adjacent violators: neighbouring days that fall are joined into a block with one
share, until the blocks rise. Requests are counted by day first; the fold runs in
the JVM over one array a key, as long as the calendar, and keys run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.functions.exprs import count_if, dround, ratio
from auctionlens.operators.funnel import CAND
from auctionlens.sources.schema import AdTables


def _share(b: Column) -> Column:
    return b["k"].cast("double") / b["n"].cast("double")


def pooled(blocks: Column) -> Column:
    """Adjacent blocks (structs ``first``, ``last``, ``days``, ``k``, ``n``, ``falls``,
    ``worst``; n above 0, in order) pooled until k / n rises strictly.

    A step joins the last two blocks of the stack if they do not rise, or else
    takes the next one; with n blocks, 2 n steps do."""

    def join(a: Column, b: Column) -> Column:
        return F.struct(
            a["first"].alias("first"), b["last"].alias("last"), (a["days"] + b["days"]).alias("days"), (a["k"] + b["k"]).alias("k"), (a["n"] + b["n"]).alias("n"),
            (a["falls"] + b["falls"]).alias("falls"), F.greatest(a["worst"], b["worst"]).alias("worst"),
        )

    def step(acc: Column, _: Column) -> Column:
        stack, m = acc["stack"], F.size(acc["stack"])
        falls = (m > 1) & (_share(F.get(stack, m - 2)) >= _share(F.get(stack, m - 1)))
        less = F.concat(F.slice(stack, 1, F.greatest(m - 2, F.lit(0))), F.array(join(F.get(stack, m - 2), F.get(stack, m - 1))))
        more = F.concat(stack, F.array(F.get(blocks, acc["i"])))
        return (
            F.when(F.coalesce(falls, F.lit(False)), F.struct(less.alias("stack"), acc["i"].alias("i")))
            .when(acc["i"] < F.size(blocks), F.struct(more.alias("stack"), (acc["i"] + 1).alias("i")))
            .otherwise(acc)
        )

    begin = F.struct(F.slice(blocks, 1, 0).alias("stack"), F.lit(0).alias("i"))
    return F.aggregate(F.sequence(F.lit(1), 2 * F.size(blocks)), begin, step, lambda acc: acc["stack"])


def rollout_curve(t: AdTables, cand: str = CAND, keys: Sequence[str] = ("os",), majority: float = 0.5) -> DataFrame:
    """The blocks of the rising share of ``cand`` per ``keys`` (columns of the
    requests).

    Per block: first and last day, number of days, requests, candidate requests,
    fitted share; ``n_falls`` and ``worst_fall``, the breaks of monotony: days of
    the block whose own share is under the day before's, and the most that one
    fell (0 if none); ``majority``: the block in which the fit first reaches that
    share, whose first day is the rollout's. Days without requests have no share
    and requests without a day take no part. Of each key's rows a day at most
    reaches the fold."""
    keys = list(keys)
    daily = t.ad_requests.filter("request_ts is not null").groupBy(*keys, F.to_date("request_ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("sdk_version") == cand).alias("k")
    )
    own = ratio("k", "n")
    fell = F.greatest(F.coalesce(F.lag(own).over(Window.partitionBy(*keys).orderBy(F.col("d").asc_nulls_last())) - own, F.lit(0.0)), F.lit(0.0))
    daily = daily.withColumn("worst", fell)
    day = F.struct(
        F.col("d").alias("first"), F.col("d").alias("last"), F.lit(1).cast("bigint").alias("days"), "k", "n",
        (F.col("worst") > 0).cast("bigint").alias("falls"), "worst",
    )
    blocks = daily.groupBy(*keys).agg(F.sort_array(F.collect_list(day)).alias("_x")).select(*keys, F.posexplode(pooled(F.col("_x"))).alias("_i", "b"))
    fit = _share(F.col("b"))
    reached = F.min(F.when(fit >= majority, F.col("_i"))).over(Window.partitionBy(*keys))
    return blocks.select(
        *keys, (F.col("_i") + 1).cast("bigint").alias("block"), F.col("b.first").alias("first_day"), F.col("b.last").alias("last_day"),
        F.col("b.days").alias("n_days"), F.col("b.n").alias("n_requests"), F.col("b.k").alias("n_cand"), dround(fit, 4).alias("share"),
        F.col("b.falls").alias("n_falls"), dround("b.worst", 4).alias("worst_fall"),
        F.coalesce(F.col("_i") == reached, F.lit(False)).alias("majority"),
    )
