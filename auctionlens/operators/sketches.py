"""Latency percentiles of any range from stored, mergeable sketches.

One KLL sketch per period, cohort and SDK version is kept as data (a binary
column, some kilobytes whatever the traffic). Percentiles of any range of whole
periods and any coarser cohort come from merging sketches: no impression is
read again. The same aggregate runs on a stream, where a window's state is one
sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.operators.funnel import REFERENCE_HINGE
from auctionlens.operators.guardrail import won_impressions
from auctionlens.sources.schema import AdTables

SKETCH_KEYS = ("sdk_version", "os", "ad_format")
#: sketch size; the error below is for this size (99 % confidence)
K = 200
RANK_ERROR = 0.0133


def month(ts: str | Column = "ts") -> Column:
    """First day of the month of ``ts``: the default period."""
    return F.trunc(F.to_date(ts), "month")


def latency_sketches(
    won: DataFrame, keys: Sequence[str] = SKETCH_KEYS, period: Column | None = None, k: int = K, latency: str = "render_latency_ms"
) -> DataFrame:
    """One row per period and ``keys``: n and the sketch of the latencies.

    ``won``: a batch or a stream with ``ts``, the keys and ``latency``; for a
    stream ``period`` is a time window of its watermarked column. Rows without
    a latency (not rendered) are left out, so every sketch holds a value."""
    value = F.col(latency).cast("bigint")
    return (
        won.filter(F.col(latency).isNotNull())
        .groupBy((month() if period is None else period).alias("period"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(value, F.lit(k)).alias("sketch"))
    )


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Adds the periods of ``sketches`` to the table at ``path``; periods that
    are there already are replaced, so a repeated load changes nothing."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def sketch_quantiles(
    sketches: DataFrame, keys: Sequence[str] = ("sdk_version",), probs: Sequence[float] = (0.5, 0.95), since: str | None = None, until: str | None = None
) -> DataFrame:
    """Per ``keys``: n, smallest, largest and the percentiles of the periods
    from ``since`` on and before ``until`` (both pruned on the stored table).
    Merging is a partial aggregate: a task sends on one sketch a group."""
    if since is not None:
        sketches = sketches.filter(F.col("period") >= F.lit(since).cast("date"))
    if until is not None:
        sketches = sketches.filter(F.col("period") < F.lit(until).cast("date"))
    g = sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("s"))
    at = [F.kll_sketch_get_quantile_bigint("s", F.lit(float(p))) for p in (0.0, 1.0, *probs)]
    names = ["least", "most", *[f"p{int(round(p * 100))}" for p in probs]]
    return g.select(*keys, F.kll_sketch_get_n_bigint("s").alias("n"), *[a.alias(n) for a, n in zip(at, names, strict=True)])


def rank_error(quantiles: DataFrame, won: DataFrame, keys: Sequence[str] = ("sdk_version",), probs: Sequence[float] = (0.5, 0.95), latency: str = "render_latency_ms") -> DataFrame:
    """Per ``keys`` how far each percentile's true rank is from the asked one
    (0 if the asked rank falls on the value), as ``<name>_error``. Rows are
    counted per key and latency before they meet the percentiles."""
    counted = won.filter(F.col(latency).isNotNull()).groupBy(*keys, F.col(latency).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    x = counted.join(quantiles, list(keys))
    names = [f"p{int(round(p * 100))}" for p in probs]
    sums = [F.sum(F.when(test, F.col("_n")).otherwise(0)).alias(f"_{n}_{side}") for n in names for side, test in (("lo", F.col("_v") < F.col(n)), ("hi", F.col("_v") <= F.col(n)))]
    g = x.groupBy(*keys).agg(F.sum("_n").alias("_all"), *sums)
    off = [F.greatest(F.lit(0.0), F.col(f"_{n}_lo") / F.col("_all") - p, p - F.col(f"_{n}_hi") / F.col("_all")) for n, p in zip(names, probs, strict=True)]
    return g.select(*keys, *[o.alias(f"{n}_error") for o, n in zip(off, names, strict=True)])


def latency_sketch_range(
    t: AdTables, path: str, since: str = REFERENCE_HINGE, until: str | None = None, keys: Sequence[str] = ("sdk_version",), probs: Sequence[float] = (0.5, 0.95), tolerance: float = 2 * RANK_ERROR
) -> DataFrame:
    """Percentiles of ``since`` to ``until`` (whole months) from the sketches
    stored at ``path``, which all won impressions are added to first, and
    whether each one's true rank is within ``tolerance``."""
    won = won_impressions(t, ("os", "ad_format"))
    store_sketches(latency_sketches(won), path)
    got = sketch_quantiles(t.ad_requests.sparkSession.read.parquet(path), keys, probs, since, until)
    won = won.filter(month() >= F.lit(since).cast("date"))
    if until is not None:
        won = won.filter(month() < F.lit(until).cast("date"))
    names = [f"p{int(round(p * 100))}" for p in probs]
    ok = [(F.col(f"{n}_error") <= tolerance).alias(f"{n}_within") for n in names]
    return got.join(rank_error(got, won, keys, probs), list(keys)).select(*keys, "n", "least", "most", *ok)
