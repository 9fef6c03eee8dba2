"""Data contracts of a growing set of tables, checked load by load.

The checks of all periods are the sums of the checks of units, sets of periods
that share no key: a request, bid, impression or event that one unit holds is
neither held nor named by another. A load of new periods is a unit of its own, so
only its facts are read. Which ids each period holds or names is stored with it,
without any fact column; a load that shares ids with earlier units (a repeated key,
a fact filed under another period than its request) is checked together with
those, exactly, and takes their place.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.operators.quality import contract_check
from auctionlens.sources.schema import FOREIGN_KEYS, PRIMARY_KEYS, AdTables

FACTS = ("ad_requests", "bids", "impressions", "sdk_events")
NO_PERIOD = "none"
ID_SCHEMA = "kind string, id string, held boolean, period string"
RESULT_SCHEMA = "unit string, check_name string, table_name string, column_name string, violations bigint, period string"


def _label(t: AdTables) -> Column:
    if not t.time_partition:
        raise ValueError("the tables have no time partition")
    return F.coalesce(F.col(t.time_partition).cast("string"), F.lit(NO_PERIOD))


def periods_of(t: AdTables) -> list[str]:
    """Labels of the periods of the facts, in order; reads the partition column alone."""
    parts = [getattr(t, n).select(_label(t).alias("p")).distinct() for n in FACTS]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    return sorted(r.p for r in both.distinct().collect())


def _only(t: AdTables, periods: Iterable[str]) -> AdTables:
    keep = _label(t).isin(sorted(periods))  # on the partition column: other periods are not read
    return replace(t, **{n: getattr(t, n).filter(keep) for n in FACTS})


def key_ids(t: AdTables) -> DataFrame:
    """Per period the distinct ids of the facts' keys: ``kind`` (the table that a
    key names), ``id`` and whether the period holds it or only names it."""
    at = [(n, PRIMARY_KEYS[n], n, True) for n in FACTS] + [(child, c, parent, False) for child, c, parent, _ in FOREIGN_KEYS if parent in FACTS]
    parts = [
        getattr(t, n).filter(F.col(c).isNotNull()).select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"), F.lit(held).alias("held"), _label(t).alias("period"))
        for n, c, kind, held in at
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    return both.groupBy("kind", "id", "period").agg(F.max("held").alias("held")).select("kind", "id", "held", "period")


def _stored(t: AdTables, path: str, schema: str) -> DataFrame:
    """The table at ``path``, which is made if there is none."""
    spark = t.ad_requests.sparkSession
    spark.createDataFrame([], schema).write.mode("append").partitionBy("period").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def linked_periods(ids: DataFrame, new: Iterable[str]) -> set[str]:
    """The other periods that share an id with ``new``, of which one side at least
    holds it. An id that both only name is an orphan in each."""
    is_new = F.col("period").isin(sorted(new))
    mine = ids.filter(is_new).groupBy("kind", "id").agg(F.max("held").alias("held"))
    shared = mine.join(ids.filter(~is_new).select("kind", "id", F.col("held").alias("_held"), "period"), ["kind", "id"]).filter("held or _held")
    return {r.period for r in shared.select("period").distinct().collect()}  # labels: no more than periods


def add_periods(t: AdTables, path: str, periods: Iterable[str] | None = None) -> list[str]:
    """Checks ``periods`` (labels; all by default) and stores ids and violations
    under ``path``. Returns the periods of the unit that was checked: those given,
    and those of the earlier units that share a key with them or held them before.

    Adding periods again replaces them, so a load that failed is repeated as it
    is. Tables at a time: one writer. A dimension that changes wants the periods
    that it concerns added again."""
    new = set(periods_of(t) if periods is None else periods)
    if not new:
        return []
    _stored(t, f"{path}/ids", ID_SCHEMA)
    _write(key_ids(_only(t, new)), f"{path}/ids")
    linked = linked_periods(t.ad_requests.sparkSession.read.schema(ID_SCHEMA).parquet(f"{path}/ids"), new)
    units = {r.period: r.unit for r in _stored(t, f"{path}/violations", RESULT_SCHEMA).select("period", "unit").distinct().collect()}
    touched = {units[p] for p in new | linked if p in units}
    unit = new | linked | {p for p, u in units.items() if u in touched}
    head = min(unit)
    rows = contract_check(_only(t, unit)).filter(F.col("table_name").isin(*FACTS))
    rows = rows.select(F.lit(head).alias("unit"), "check_name", "table_name", "column_name", "violations", F.lit(head).alias("period"))
    # the unit's other periods hold a row that says where their checks are
    rest = t.ad_requests.sparkSession.createDataFrame([(head, None, None, None, None, p) for p in sorted(unit - {head})], RESULT_SCHEMA)
    _write(rows.unionByName(rest), f"{path}/violations")
    return sorted(unit)


def profile_report(t: AdTables, path: str) -> DataFrame:
    """The rows of ``contract_check`` over all periods added to ``path``, from the
    stored violations; of ``t`` only the dimensions are read."""
    stored = _stored(t, f"{path}/violations", RESULT_SCHEMA).filter("check_name is not null")
    facts = stored.groupBy("check_name", "table_name", "column_name").agg(F.sum("violations").alias("violations"))
    none = replace(t, **{n: getattr(t, n).filter(F.lit(False)) for n in FACTS})
    return facts.unionByName(contract_check(none).filter(~F.col("table_name").isin(*FACTS)))


def contract_profiles(t: AdTables, path: str, later: int = 1) -> DataFrame:
    """The contracts of all periods, checked in two loads: the last ``later``
    periods come after the others, whose facts are then not read again."""
    periods = periods_of(t)
    cut = max(len(periods) - later, 0)
    add_periods(t, path, periods[:cut])
    add_periods(t, path, periods[cut:])
    return profile_report(t, path)
