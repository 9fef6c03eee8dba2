"""The six-table ad-auction data model: schemas and key contracts.

Ids are strings in reference-shaped data and bigint in the testdata-derived
views; no operator depends on the id type, only on equality.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


PUBLISHERS = _struct(("publisher_id", I), ("publisher_name", S), ("tier", S), ("region", S))
BUYERS = _struct(("buyer_id", I), ("buyer_name", S), ("billing_type", S))
AD_REQUESTS = _struct(
    ("request_id", S), ("request_ts", TS), ("publisher_id", I), ("app_id", S),
    ("sdk_version", S), ("os", S), ("os_version", S), ("device_model", S),
    ("country", S), ("ad_format", S), ("placement_id", S),
)
BIDS = _struct(
    ("bid_id", S), ("request_id", S), ("buyer_id", I), ("bid_cpm", D), ("did_bid", I),
    ("is_winner", I), ("cleared_price", D), ("bid_ttl_ms", I),
)
IMPRESSIONS = _struct(
    ("impression_id", S), ("request_id", S), ("winning_bid_id", S), ("render_start_ts", TS),
    ("render_complete_ts", TS), ("render_latency_ms", I), ("rendered", B), ("viewable", B),
    ("video_completed", B), ("billable", B), ("revenue_usd", D),
)
SDK_EVENTS = _struct(
    ("event_id", S), ("request_id", S), ("event_type", S), ("error_code", S),
    ("latency_ms", I), ("event_ts", TS),
)

SCHEMAS: dict[str, T.StructType] = {
    "publishers": PUBLISHERS,
    "buyers": BUYERS,
    "ad_requests": AD_REQUESTS,
    "bids": BIDS,
    "impressions": IMPRESSIONS,
    "sdk_events": SDK_EVENTS,
}

# Primary keys as declared by the reference DDL.
PRIMARY_KEYS: dict[str, str] = {
    "publishers": "publisher_id",
    "buyers": "buyer_id",
    "ad_requests": "request_id",
    "bids": "bid_id",
    "impressions": "impression_id",
    "sdk_events": "event_id",
}

# Foreign keys implied by the reference joins,
# (child table, child column, parent table, parent column).
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("bids", "request_id", "ad_requests", "request_id"),
    ("impressions", "request_id", "ad_requests", "request_id"),
    ("sdk_events", "request_id", "ad_requests", "request_id"),
    ("impressions", "winning_bid_id", "bids", "bid_id"),
    ("bids", "buyer_id", "buyers", "buyer_id"),
    ("ad_requests", "publisher_id", "publishers", "publisher_id"),
]

# Expected row counts of the reference sample after load.
REFERENCE_ROW_COUNTS: dict[str, int] = {
    "ad_requests": 2600,
    "bids": 7766,
    "impressions": 2230,
    "sdk_events": 6976,
    "publishers": 6,
    "buyers": 8,
}


TABLE_NAMES = ("ad_requests", "bids", "impressions", "sdk_events", "buyers", "publishers")
TIME_PARTITION = "request_period"


def period_start(ts, unit: str):
    """First day of the period (day, month or year) holding ``ts``, as a date."""
    from pyspark.sql import functions as F

    d = F.to_date(ts)
    return d if unit == "day" else F.trunc(d, unit)


@dataclass(frozen=True)
class AdTables:
    """The six tables every operator reads. All are lazy DataFrames.

    ``winning_bid_in_request`` declares that every impression's winning bid
    belongs to the impression's own request (``contract_check`` verifies it:
    ``rule_winning_bid_other_request`` = 0). Operators then join impressions
    to bids on (request_id, bid_id), which tables bucketed by request_id
    answer without a shuffle; otherwise they join on the bid id alone.

    ``time_partition`` names a partition column present on all four facts:
    the first day of the request's period (``time_unit``: day, month or
    year). Post-hinge operators add ``since(fact, hinge)``, a filter on it
    implied by ``request_ts >= hinge``, so fact scans skip older partitions.
    """

    ad_requests: DataFrame
    bids: DataFrame
    impressions: DataFrame
    sdk_events: DataFrame
    buyers: DataFrame
    publishers: DataFrame
    winning_bid_in_request: bool = False
    time_partition: str | None = None
    time_unit: str = "year"
    _dims: dict = field(default_factory=dict, repr=False, compare=False)

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_NAMES}

    def since(self, fact: DataFrame, hinge: str) -> DataFrame:
        """Partition pruning for facts of requests at or after ``hinge``: a
        superset filter (the exact one stays on the requests side)."""
        if not self.time_partition:
            return fact
        from pyspark.sql import functions as F

        return fact.filter(F.col(self.time_partition) >= period_start(F.lit(hinge).cast("timestamp_ntz"), self.time_unit))

    def dimension(self, name: str, *cols: str) -> DataFrame:
        """A dimension projected to ``cols``, broadcast only if its statistics
        prove it small (``bounded_broadcast``)."""
        from auctionlens.plans.joins import bounded_broadcast

        key = (name, cols)
        if key not in self._dims:
            self._dims[key] = bounded_broadcast(getattr(self, name).select(*cols))
        return self._dims[key]
