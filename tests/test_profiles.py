"""Contracts checked load by load equal the contracts of all rows."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from auctionlens.operators import profiles
from auctionlens.operators.quality import contract_check

FACTS = profiles.FACTS


@pytest.fixture
def filed(micro):
    """Tables whose facts are filed by the first letter of their id's own column."""

    def build(requests, bids, impressions, events=()):
        t = micro(requests=requests, bids=bids, impressions=impressions, events=events)
        at = {"ad_requests": "request_id", "bids": "bid_id", "impressions": "impression_id", "sdk_events": "event_id"}
        return replace(t, time_partition="request_period", **{n: getattr(t, n).withColumn("request_period", F.substring(c, 1, 1)) for n, c in at.items()})

    return build


def _period(p, n=4):
    """Requests, bids and impressions of one period; one impression breaks the billing rule."""
    ids = [f"{p}{i}" for i in range(n)]
    return (
        [dict(request_id=i) for i in ids],
        [dict(bid_id=i, request_id=i, is_winner=1, cleared_price=4.0) for i in ids],
        [dict(impression_id=i, request_id=i, billable=i != f"{p}1", revenue_usd=0.004 if i != f"{p}1" else 0.0) for i in ids],
    )


def _both(a, b):
    return [x + y for x, y in zip(a, b, strict=True)]


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_loads_without_shared_keys_are_units_of_their_own(spark, filed, tmp_path):
    reqs, bids, imps = _both(_period("A"), _period("B"))
    # both name a request that nobody holds: an orphan in either, and no link
    imps += [dict(impression_id=f"{p}9", request_id="Z", winning_bid_id=f"{p}0") for p in "AB"]
    t = filed(reqs, bids, imps)
    path = str(tmp_path / "p")
    assert profiles.periods_of(t) == ["A", "B"]
    assert profiles.add_periods(t, path, ["A"]) == ["A"]
    assert profiles.add_periods(t, path, ["B"]) == ["B"]
    want = _rows(contract_check(t))
    assert ("fk_orphan", "impressions", "request_id", 2) in want
    assert _rows(profiles.profile_report(t, path)) == want


def test_links_are_keys_that_one_side_holds(spark, filed):
    reqs, bids, imps = [sum(x, []) for x in zip(*[_period(p, 3) for p in "ABCDEFG"], strict=True)]
    bids.append(dict(bid_id="B7", request_id="A2"))  # a request of another period
    imps.append(dict(impression_id="C7", request_id="C0", winning_bid_id="D1"))  # a bid of another period
    bids += [dict(bid_id="E8", request_id="Z"), dict(bid_id="F8", request_id="Z")]  # an orphan of both
    t = filed(reqs, bids, imps)
    twice = t.bids.filter("bid_id = 'E1'").withColumn("request_period", F.lit("G"))  # a repeated bid, and its request
    ids = profiles.key_ids(replace(t, bids=t.bids.unionByName(twice)))
    got = {p: profiles.linked_periods(ids, [p]) for p in "ABCDEFG"}
    assert got == {"A": {"B"}, "B": {"A"}, "C": {"D"}, "D": {"C"}, "E": {"G"}, "F": set(), "G": {"E"}}
    assert profiles.linked_periods(ids, ["A", "C"]) == {"B", "D"}


def test_a_corrected_load_takes_the_place_of_the_faulty_one(spark, filed, tmp_path):
    reqs, bids, imps = _both(_period("A"), _period("B"))
    path = str(tmp_path / "p")
    bad = filed(reqs, [*bids, dict(bid_id="B7", request_id="A2", bid_cpm=None)], imps)
    assert profiles.add_periods(bad, path, ["A"]) == ["A"] and profiles.add_periods(bad, path, ["B"]) == ["A", "B"]
    assert _rows(profiles.profile_report(bad, path)) == _rows(contract_check(bad))
    good = filed(reqs, bids, imps)
    assert profiles.add_periods(good, path, ["B"]) == ["A", "B"]
    assert _rows(profiles.profile_report(good, path)) == _rows(contract_check(good))


def test_empty_tables_and_tables_without_periods(spark, micro, filed, tmp_path):
    t = filed([], [], [])
    assert profiles.add_periods(t, str(tmp_path / "p")) == []
    rows = _rows(profiles.profile_report(t, str(tmp_path / "p")))
    assert {r[1] for r in rows} == {"publishers", "buyers"} and not any(r[3] for r in rows)
    with pytest.raises(ValueError):
        profiles.add_periods(micro(), str(tmp_path / "q"))


def test_a_load_reads_its_own_periods_only(t001):
    from auctionlens.plans.inspect import formatted_plan

    label = profiles.periods_of(t001)[-1]
    for name in FACTS:
        plan = formatted_plan(getattr(profiles._only(t001, [label]), name))
        assert "PartitionFilters: [" in plan and label in plan.split("PartitionFilters: [")[1].split("]")[0]
