"""Sizes read from a plan's statistics; no job is run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that ``df`` returns (files: their size)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of all sources that ``df`` reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
