"""Join helpers that keep broadcast behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionlens.plans.stats import plan_bytes

# A dimension is broadcast only when the plan's statistics put it at no more
# than this many bytes. Callers project it to the join key and one or two
# attributes first. Above the bound nothing is hinted and the planner shuffles
# (or adaptive execution converts the join once it has measured the side).
BROADCAST_MAX_BYTES = 32 * 1024 * 1024


def bounded_broadcast(dim: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Return ``dim`` with a broadcast hint if it has at most ``max_bytes`` bytes
    by its statistics. No job runs while the plan is built."""
    return F.broadcast(dim) if plan_bytes(dim) <= max_bytes else dim


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner", max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Fact-to-dimension join; the dimension is broadcast only when proven small."""
    return fact.join(bounded_broadcast(dim, max_bytes), on, how)
