from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from auctionlens.plans.session import get_session

    s = get_session(master="local[4]", app="auctionlens-tests", conf={"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def t001(spark):
    from auctionlens.sources.fixtures import FIXTURE_HINGE, fixture_tables

    return fixture_tables(spark, SF001, hinge=FIXTURE_HINGE)


# ---------------------------------------------------------------- micro tables

REQ_DEFAULT = dict(
    request_ts=datetime(2026, 5, 25, 12), publisher_id=1, app_id="app", sdk_version="8.1.0", os="iOS",
    os_version="17.1.2", device_model="iPhone14,5", country="US", ad_format="rewarded_video", placement_id="plc",
)
BID_DEFAULT = dict(buyer_id=2, bid_cpm=5.0, did_bid=1, is_winner=0, cleared_price=None, bid_ttl_ms=1800)
IMP_DEFAULT = dict(
    render_start_ts=None, render_complete_ts=None, render_latency_ms=400, rendered=True, viewable=True,
    video_completed=True, billable=True, revenue_usd=0.004,
)
# The reference sample's buyers and publishers.
BUYERS = [
    (1, "BrandReach", "viewable"), (2, "PerformIQ", "render"), (3, "VideoMax", "complete"),
    (4, "AdsGlobal", "render"), (5, "ViewFirst", "viewable"), (6, "GameAds", "complete"),
    (7, "MediaPlus", "render"), (8, "PrimeBid", "viewable"),
]
PUBLISHERS = [
    (1, "GG Studios", "Tier-1", "NA"), (2, "PixelForge", "Tier-1", "EU"), (3, "Nova Games", "Tier-1", "APAC"),
    (4, "Casual King", "Tier-1", "NA"), (5, "Indie Bay", "Tier-2", "EU"), (6, "ArcadeNow", "Tier-2", "APAC"),
]


def _rows(schema, rows, defaults):
    names = schema.fieldNames()
    out = []
    for r in rows:
        d = {**defaults, **r}
        out.append(tuple(d.get(n) for n in names))
    return out


@pytest.fixture(scope="session")
def micro(spark):
    """Build reference-shaped AdTables (string ids) from row dicts."""
    from auctionlens.sources.schema import SCHEMAS, AdTables

    def build(requests=(), bids=(), impressions=(), events=(), buyers=None, publishers=None) -> AdTables:
        mk = lambda name, rows, dflt: spark.createDataFrame(_rows(SCHEMAS[name], rows, dflt), SCHEMAS[name])
        imps = [{**r, "winning_bid_id": r.get("winning_bid_id", r.get("impression_id"))} for r in impressions]
        return AdTables(
            ad_requests=mk("ad_requests", requests, REQ_DEFAULT),
            bids=mk("bids", bids, BID_DEFAULT),
            impressions=mk("impressions", imps, IMP_DEFAULT),
            sdk_events=mk("sdk_events", events, {"event_ts": datetime(2026, 5, 25)}),
            buyers=spark.createDataFrame(buyers or BUYERS, SCHEMAS["buyers"]),
            publishers=spark.createDataFrame(publishers or PUBLISHERS, SCHEMAS["publishers"]),
        )

    return build
