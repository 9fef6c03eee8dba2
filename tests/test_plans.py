"""Physical-plan checks: pushdown, broadcast of checked dimensions, no
Python in any plan, and co-located (bucketed) fact joins."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from auctionlens import oracle
from auctionlens.operators import cohorts, mechanism
from auctionlens.sources.fixtures import FIXTURE_HINGE as H

from conftest import SF001

from auctionlens.plans.inspect import exchanges, python_nodes
from auctionlens.plans.inspect import formatted_plan as plan


AD_QUERIES = sorted(k for k in E.queries() if k in oracle.QUERIES)


@pytest.mark.parametrize("key", [k for k in AD_QUERIES if not k.startswith("guardrail_stream")])
def test_no_python_in_plan(spark, key):
    assert python_nodes(E.queries()[key](spark, SF001)) == [], key


def test_hinge_and_cohort_filters_reach_the_scan(t001):
    p = plan(mechanism.latency_vs_ttl(t001, hinge=H))
    scans = [line for line in p.splitlines() if line.startswith("PushedFilters") and "request_ts" in line]
    assert scans, p
    assert "GreaterThanOrEqual(request_ts,1998-07-01T00:00)" in scans[0]
    assert "EqualTo(os,iOS)" in scans[0] and "EqualTo(ad_format,rewarded_video)" in scans[0]


def test_buyers_broadcast_after_size_check(t001):
    p = plan(mechanism.billing_type_split(t001, hinge=H))
    assert "BroadcastHashJoin" in p


def test_bucketed_fact_join_needs_no_shuffle_of_facts(spark, t001):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the shuffle-join path
    try:
        p = plan(cohorts.cohort_version_compare(t001, hinge=H))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert "SortMergeJoin" in p
    assert "Exchange hashpartitioning(request_id" not in p


def test_winning_bid_join_is_colocated(spark, t001):
    """Declared same-request bids: the impression -> bid join reads buckets in place."""
    assert t001.winning_bid_in_request
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(mechanism.latency_vs_ttl(t001, hinge=H))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert "Exchange hashpartitioning(winning_bid_id" not in p and "Exchange hashpartitioning(bid_id" not in p
    assert "Exchange hashpartitioning(request_id" not in p


FACT_KEYS = ("request_id", "bid_id", "winning_bid_id", "impression_id", "event_id")


@pytest.mark.parametrize("key", [k for k in AD_QUERIES if not k.startswith("guardrail_stream") and not k.startswith("contract_check")])
def test_no_fact_shuffle_when_nothing_is_broadcast(spark, key):
    """With automatic broadcast off (every fact too big to broadcast), the
    analytical queries still never shuffle a fact table on its keys: fact
    joins are bucket-aligned, and the remaining exchanges follow partial
    aggregation."""
    prev = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in prev:
        spark.conf.set(k, "-1")
    try:
        ex = exchanges(E.queries()[key](spark, SF001))
    finally:
        for k, v in prev.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert not [e for e in ex if any(f"({k}" in e or f" {k}," in e for k in FACT_KEYS)], ex


def test_prepartitioned_write_is_verified_on_the_plan(spark, t001):
    """A fact is written without a new shuffle only when its plan proves the
    request_id layout; a join re-partitioned on another key does not."""
    from auctionlens.plans.inspect import hash_partitioned_on

    n = 6
    x = t001.bids.repartition(n, "request_id")
    assert hash_partitioned_on(x, "request_id", n)
    assert not hash_partitioned_on(x, "request_id", n + 1)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_buyer = x.join(t001.buyers.select("buyer_id", "billing_type"), "buyer_id")
        assert not hash_partitioned_on(by_buyer, "request_id", n)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_post_hinge_scans_skip_older_partitions(t001):
    """Time-partitioned facts: every fact scan of a post-hinge query carries
    a partition filter from the hinge (pre-hinge years are never read)."""
    assert t001.time_partition == "request_period"
    for df in (mechanism.latency_vs_ttl(t001, hinge=H), mechanism.error_trail(t001, hinge=H)):
        p = plan(df)
        scans = [b for b in p.split("\n\n") if b.startswith("(") and "Scan parquet" in b.splitlines()[0] and "buyers" not in b]
        assert scans
        for b in scans:
            assert "PartitionFilters: [isnotnull(request_period#" in b and ">= 1998-01-01)" in b, b


def test_broadcast_only_below_the_checked_bound(spark):
    """bounded_broadcast hints a dimension only when its statistics prove it small;
    over the bound the join is left to the shuffle planner."""
    from auctionlens.plans.joins import bounded_broadcast

    fact = spark.range(1000).withColumnRenamed("id", "k")
    dim = spark.range(10).withColumnRenamed("id", "k")
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = plan(fact.join(bounded_broadcast(dim, max_bytes=80), "k"))
        large = plan(fact.join(bounded_broadcast(dim, max_bytes=79), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert "BroadcastHashJoin" in small
    assert "BroadcastHashJoin" not in large and "SortMergeJoin" in large


def test_checked_dimension_is_kept(t001):
    a = t001.dimension("buyers", "buyer_id", "billing_type")
    assert t001.dimension("buyers", "buyer_id", "billing_type") is a
