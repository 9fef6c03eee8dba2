"""Column-expression helpers shared by every operator.

All helpers return plain ``pyspark.sql.Column`` objects built from
built-in functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Era labels, sort so that pre < post.
ERA_PRE = "1_pre"
ERA_POST = "2_post"

# Money is summed as a decimal so the total does not depend on row order
# or partitioning. 12 decimals hold every revenue value exactly; 16 digits
# before the point hold any single amount, and sums widen to decimal(38,12).
MONEY_TYPE = "decimal(28,12)"

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value: str) -> Column:
    """A timestamp-without-zone literal (``TIMESTAMP 'x'`` in SQL)."""
    return F.lit(value).cast("timestamp_ntz")


def era(ts: ColumnOrName, hinge: str) -> Column:
    """Half-open hinge: ``ts < hinge`` is pre, everything else (NULL too) is post."""
    return F.when(col(ts) < ts_lit(hinge), F.lit(ERA_PRE)).otherwise(F.lit(ERA_POST))


def is_true(c: ColumnOrName) -> Column:
    """SQL ``c IS TRUE``: NULL counts as false."""
    return F.coalesce(col(c), F.lit(False))


def count_if(p: Column) -> Column:
    """Rows where ``p`` is true, as bigint (0 for a group without such rows)."""
    return F.count_if(F.coalesce(p, F.lit(False))).cast("bigint")


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / NULLIF(den, 0)`` in double; NULL on a zero or NULL denominator."""
    return F.try_divide(col(num).cast("double"), F.nullif(col(den).cast("double"), F.lit(0.0)))


def money(c: ColumnOrName) -> Column:
    """``COALESCE(c, 0)`` as an exact decimal, ready for ``sum``."""
    return F.coalesce(col(c), F.lit(0.0)).cast(MONEY_TYPE)


def dround(c: ColumnOrName, n: int) -> Column:
    """``ROUND(c::numeric, n)``: half away from zero on a decimal, then double."""
    return F.round(col(c).cast("decimal(38,10)"), n).cast("double")


def os_major(os_version: ColumnOrName = "os_version") -> Column:
    """``split_part(os_version, '.', 1)``: '17.1.2' -> '17', '14' -> '14'."""
    return F.split_part(col(os_version), F.lit("."), F.lit(1))


def case_label(cases: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """First-match-wins CASE: ``[(label, predicate), ...]`` -> label column.

    With ``default=None`` there is no ELSE, so unmatched rows get NULL.
    """
    out = None
    for label, pred in cases:
        out = F.when(pred, F.lit(label)) if out is None else out.when(pred, F.lit(label))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(F.lit(default))


def any_of(preds: Iterable[Column]) -> Column:
    """OR of predicates; used as the filter implied by a CASE label being non-NULL."""
    out = None
    for p in preds:
        out = p if out is None else (out | p)
    return F.lit(True) if out is None else out


def version_rate(version: ColumnOrName, value: str, hit: Column) -> tuple[Column, Column]:
    """(count of rows on ``value``, rate of ``hit`` among them) for a pivot by version."""
    on_v = col(version) == F.lit(value)
    n = count_if(on_v)
    return n, ratio(count_if(on_v & hit), n)
