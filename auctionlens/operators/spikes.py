"""D08 with error control: which error codes spike, over all cohorts and codes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.functions.exprs import count_if, dround, os_major, ratio, ts_lit
from auctionlens.operators.funnel import BASE, CAND, REFERENCE_HINGE
from auctionlens.sources.schema import AdTables

TERMS = 200


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal variable, from built-in functions.

    From 1 on it is the density times the continued fraction
    ``1 / (z + 1 / (z + 2 / (z + ...)))``, exact to rounding however small the
    tail; nearer to 0 the power series about 0; below -1 by symmetry."""
    density = F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    far = F.abs(z)
    steps = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    beyond = density / F.aggregate(steps, far, lambda acc, k: far + k / acc)
    powers = F.aggregate(
        F.sequence(F.lit(1), F.lit(30)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, k: F.struct((acc["term"] * z * z / (2 * k + 1)).alias("term"), (acc["total"] + acc["term"] * z * z / (2 * k + 1)).alias("total")),
    )["total"]
    return F.when(z >= 1.0, beyond).when(z <= -1.0, 1.0 - beyond).otherwise(0.5 - density * powers)


def error_spikes(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    keys: Sequence[str] = ("os", "os_major", "ad_format"),
    fdr: float = 0.05,
) -> DataFrame:
    """Error codes whose rate per impression is higher on ``cand`` than on
    ``base``, tested in every cohort, with the false discovery rate held at ``fdr``.

    Under equal rates the candidate's share of a cohort's errors of a code is its
    share of the impressions; ``p_value`` is the upper tail of the normal
    approximation with continuity correction. All cohorts with impressions of both
    versions times all codes seen there are tests (a code that a cohort lacks has p = 1
    and no row). ``q_value`` is Benjamini and Hochberg's: the least, over p-values
    as large or larger, of p * tests / rank. A code in a cohort without impressions
    of one version is no test and has no row. NULL key values are a cohort of their own.

    Events and impressions are tallied apart by cohort before they meet; the windows
    without partition run over one row per cohort and code.
    """
    keys = list(keys)
    need = dict.fromkeys(k if k != "os_major" else "os_version" for k in keys)
    req = t.since(t.ad_requests, hinge).filter(F.col("sdk_version").isin(base, cand) & (F.col("request_ts") >= ts_lit(hinge)))
    req = req.select("request_id", "sdk_version", *need)
    if "os_major" in keys:
        req = req.withColumn("os_major", os_major())
    is_b, is_c = F.col("sdk_version") == base, F.col("sdk_version") == cand
    imps = t.since(t.impressions, hinge).select("request_id").join(req, "request_id").groupBy(*keys).agg(
        count_if(is_b).alias("imps_base"), count_if(is_c).alias("imps_cand")
    ).filter((F.col("imps_base") > 0) & (F.col("imps_cand") > 0))
    errs = t.since(t.sdk_events, hinge).filter(F.col("error_code").isNotNull()).select("request_id", "error_code").join(req, "request_id").groupBy(*keys, "error_code").agg(
        count_if(is_b).alias("n_base"), count_if(is_c).alias("n_cand")
    )
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    x = imps.alias("i").join(errs.alias("e"), same, "left").select(*[f"i.{k}" for k in keys], "error_code", "n_base", "n_cand", "imps_base", "imps_cand")

    everything = Window.partitionBy()
    cohort = F.dense_rank().over(Window.orderBy(*[F.col(k).asc_nulls_last() for k in keys]))
    code = F.when(F.col("error_code").isNotNull(), F.dense_rank().over(Window.orderBy(F.col("error_code").asc_nulls_last())))
    x = x.withColumns({"_cohort": cohort, "_code": code})
    x = x.withColumn("_tests", F.max("_cohort").over(everything) * F.max("_code").over(everything))
    n = F.col("n_base") + F.col("n_cand")
    mean = n * F.col("imps_cand") / (F.col("imps_base") + F.col("imps_cand"))
    spread = F.sqrt(mean * F.col("imps_base") / (F.col("imps_base") + F.col("imps_cand")))
    x = x.filter(F.col("error_code").isNotNull()).withColumn("z", (F.col("n_cand") - mean - 0.5) / spread)
    x = x.withColumn("p", upper_tail(F.col("z")))
    rank = F.row_number().over(Window.orderBy(F.col("p").asc_nulls_last(), F.col("error_code").asc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]))
    x = x.withColumn("_rank", rank).withColumn("_scaled", F.least(F.lit(1.0), F.col("p") * F.col("_tests") / F.col("_rank")))
    x = x.withColumn("q", F.min("_scaled").over(Window.orderBy(F.col("_rank").desc_nulls_last())))
    return x.select(
        *keys, "error_code", "n_base", "n_cand", "imps_base", "imps_cand",
        dround(ratio("n_base", "imps_base") * 1000.0, 3).alias("per_1000_base"),
        dround(ratio("n_cand", "imps_cand") * 1000.0, 3).alias("per_1000_cand"),
        dround("z", 3).alias("z"), dround("p", 6).alias("p_value"), dround("q", 6).alias("q_value"),
        (F.col("q") <= fdr).alias("spike"),
    )
