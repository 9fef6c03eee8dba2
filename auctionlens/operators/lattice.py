"""D01 by all cohorts at once: the shortest descriptions of a drop.

Every combination of values of every subset of the keys is a cohort; the
candidate version is compared with the base in each. Of the cohorts that drop
as a whole, only those are told that no coarser one explains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.functions.exprs import count_if, dround, ratio
from auctionlens.operators.cohorts import rendered_post
from auctionlens.operators.funnel import BASE, CAND, REFERENCE_HINGE
from auctionlens.sources.schema import AdTables

MAX_KEYS = 10  # 2 ** keys cohorts hold a row
TALLIES = ("n_base", "n_cand", "k_base", "k_cand")


def _item(key: str) -> Column:
    return F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("(null)")))


def _sums() -> list[Column]:
    return [F.sum(c).cast("bigint").alias(c) for c in TALLIES]


def _lattice(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tallies of every cohort. ``items`` are its ``key=value`` texts, sorted."""
    kept = [F.when(F.getbit(F.col("_gid"), F.lit(len(keys) - 1 - i)) == 0, _item(k)) for i, k in enumerate(keys)]
    cube = cells.cube(*keys).agg(*_sums(), F.grouping_id().alias("_gid"))
    return cube.select(F.array_sort(F.array_compact(F.array(*kept))).alias("items"), *TALLIES)


def _variance(k: str, n: str) -> Column:
    """Variance of a rate, estimated with one hit and one miss more, so that it is never 0."""
    p = (F.col(k) + 1.0) / (F.col(n) + 2.0)
    return p * (1.0 - p) / F.col(n)


def _with_change(c: DataFrame) -> DataFrame:
    """Rates of both versions, their difference, its standard error and their ratio ``z``."""
    c = c.withColumns({"br_base": ratio("k_base", "n_base"), "br_cand": ratio("k_cand", "n_cand")})
    c = c.withColumns({"delta": F.col("br_cand") - F.col("br_base"), "se": F.sqrt(_variance("k_base", "n_base") + _variance("k_cand", "n_cand"))})
    return c.withColumn("z", F.col("delta") / F.col("se"))


def _subsets(items: Column) -> Column:
    """All subsets of an array of at most ``MAX_KEYS`` items, each in the array's order."""
    start = F.array(F.array().cast("array<string>"))
    return F.aggregate(items, start, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))


def cohort_lattice(
    t: AdTables,
    hinge: str = REFERENCE_HINGE,
    base: str = BASE,
    cand: str = CAND,
    keys: Sequence[str] = ("os", "os_major", "ad_format", "country"),
    min_n: int = 15,
    min_drop: float = 0.1,
    z_min: float = 4.0,
    share: float = 0.5,
    contrast: float = 1.0,
) -> DataFrame:
    """The shortest descriptions of where the billable rate of ``cand`` drops.

    A cohort needs ``min_n`` rows of both versions. It *drops* if its rate falls by
    ``min_drop`` or more and by ``z_min`` standard errors
    (4, since cohorts are many), and it drops *as a whole*
    if no cohort with one key more contradicts it: one contradicts whose change lies
    ``contrast`` of its standard errors above ``share`` of the change of the coarser
    one. So a cohort that only holds a faulty one is not told in its place.
    A cohort is explained if a coarser one that drops as a whole holds all its rows;
    items that hold in all rows of a cohort (``implied``) count for that, and of
    several descriptions of the same rows the shortest, then the first by text, stays.
    Those left may still overlap: rows belong to the one with the least ``z`` that
    holds them, and a cohort is told only if it drops in its own rows as well
    (``own_delta``), so that one which merely shares rows with a fault is not.
    Changes are judged once, before rows are given out: a second fault inside a cohort
    whose other parts drop by half as much through another fault is told as that cohort.

    A NULL key value is the value ``(null)``. Without any version rows the result is
    empty. Impressions are tallied by all keys once; the cube is taken over those
    tallies, and cohorts meet by equal items: one row for a key left out, or for a
    subset of its items (at most ``2 ** MAX_KEYS``).
    """
    keys = list(keys)
    if not 1 <= len(keys) <= MAX_KEYS:
        raise ValueError(f"from 1 to {MAX_KEYS} keys, not {len(keys)}")
    x = rendered_post(t, hinge, F.col("sdk_version").isin(base, cand))
    is_b, is_c = F.col("sdk_version") == base, F.col("sdk_version") == cand
    cells = x.groupBy(*keys).agg(
        count_if(is_b).alias("n_base"), count_if(is_c).alias("n_cand"),
        count_if(is_b & F.col("billable")).alias("k_base"), count_if(is_c & F.col("billable")).alias("k_cand"),
    )
    enough = (F.col("n_base") >= min_n) & (F.col("n_cand") >= min_n)
    dropped = (F.col("delta") <= -min_drop) & (F.col("z") <= -z_min)
    c = _with_change(_lattice(cells, keys).filter(enough))

    finer = c.select(F.explode("items").alias("item"), F.col("items").alias("_all"), F.col("delta").alias("_delta"), F.col("se").alias("_se"), (F.col("n_base") + F.col("n_cand")).alias("_n"))
    finer = finer.select(F.array_remove("_all", F.col("item")).alias("items"), "item", "_delta", "_se", "_n")
    drops = c.filter(dropped)
    against = F.col("_delta") - F.lit(contrast) * F.col("_se") > F.lit(share) * F.col("delta")
    told = drops.join(finer, "items", "left").groupBy(*drops.columns).agg(
        F.max(F.coalesce(against, F.lit(False))).alias("_against"),
        F.array_sort(F.collect_set(F.when(F.col("_n") == F.col("n_base") + F.col("n_cand"), F.col("item")))).alias("_implied"),
    )
    whole = told.filter(~F.col("_against")).drop("_against").withColumn("_closure", F.array_sort(F.array_union("items", "_implied")))

    def order(prefix: str = "") -> Column:
        return F.struct(F.size(f"{prefix}_closure"), F.size(f"{prefix}items"), F.array_join(f"{prefix}items", ", "))

    coarse = whole.select(F.col("items").alias("_subset"), order().alias("_first"))
    held = whole.select("items", order().alias("_own"), F.explode(_subsets(F.col("_closure"))).alias("_subset"))
    explained = held.join(coarse, "_subset").filter(F.col("_first") < F.col("_own")).select("items").distinct()
    left = whole.join(explained, "items", "left_anti")

    # a cell of the finest cohorts belongs to the strongest description that holds it
    finest = cells.select(F.explode(_subsets(F.array_sort(F.array(*[_item(k) for k in keys])))).alias("items"), F.struct(*keys).alias("_cell"), *TALLIES)
    strongest = Window.partitionBy("_cell").orderBy(F.col("z").asc_nulls_last(), F.array_join("items", ", ").asc_nulls_last())
    holders = finest.join(left.select("items", "z"), "items").withColumn("_nth", F.row_number().over(strongest))
    own = _with_change(holders.filter(F.col("_nth") == 1).groupBy("items").agg(*_sums()).filter(enough)).filter(dropped)
    return left.join(own.select("items", F.col("delta").alias("_own_delta")), "items").select(
        F.array_join("items", ", ").alias("cohort"),
        F.size("items").cast("bigint").alias("n_keys"),
        F.array_join("_implied", ", ").alias("implied"),
        "n_base", "n_cand",
        dround("br_base", 3).alias("br_base"),
        dround("br_cand", 3).alias("br_cand"),
        dround("delta", 3).alias("delta"),
        dround("z", 3).alias("z"),
        dround("_own_delta", 3).alias("own_delta"),
        F.rank().over(Window.orderBy(F.col("z").asc_nulls_last())).cast("bigint").alias("worst_rank"),
    )
