"""Load checks: A10 row-count verification and D14 data contracts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.exprs import count_if, is_true
from auctionlens.operators.funnel import _billing_signal
from auctionlens.plans.joins import bounded_broadcast
from auctionlens.sources.schema import FOREIGN_KEYS, PRIMARY_KEYS, AdTables
from auctionlens.sources.tables import default_buckets

#: bids that one task of contract_check compares by id, about
TASK_BIDS = 500_000


def load_verification(
    tables: Mapping[str, DataFrame],
    expected: Mapping[str, int | DataFrame | None] | None = None,
) -> DataFrame:
    """A10: one row per table with its count, the expectation and ``ok``.

    An expectation is a literal count, a DataFrame whose row count is
    expected (e.g. the source the table was loaded from), or None. All
    counts are tallied as tagged rows and pivoted by one aggregate, so no
    cross join is needed.
    """
    expected = expected or {}
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), F.lit("actual").alias("kind"), "n"))
        exp = expected.get(name)
        if isinstance(exp, DataFrame):
            parts.append(exp.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), F.lit("expected").alias("kind"), "n"))
        elif exp is not None:
            parts.append(
                parts[-1].sparkSession.range(1).select(
                    F.lit(name).alias("t"), F.lit("expected").alias("kind"), F.lit(int(exp)).cast("bigint").alias("n")
                )
            )
    tall = parts[0]
    for p in parts[1:]:
        tall = tall.unionByName(p)
    g = tall.groupBy("t").agg(
        F.max(F.when(F.col("kind") == "actual", F.col("n"))).alias("n"),
        F.max(F.when(F.col("kind") == "expected", F.col("n"))).alias("expected"),
    )
    return g.select(
        "t",
        F.col("n").cast("bigint").alias("n"),
        F.col("expected").cast("bigint").alias("expected"),
        (F.col("n") == F.col("expected")).alias("ok"),
    )


def _row(check: str, table: str, column: str, violations: Column) -> list[Column]:
    return [
        F.lit(check).alias("check_name"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        violations.cast("bigint").alias("violations"),
    ]


def _rules(t: AdTables) -> dict[str, list[tuple[str, str, Column]]]:
    """Conditional rules of the data model, as (check, column, violation predicate)."""
    c = F.col
    return {
        "bids": [
            ("rule_cpm_null_iff_no_bid", "bid_cpm", c("bid_cpm").isNull() != (c("did_bid") == 0)),
            ("rule_cleared_iff_winner", "cleared_price", c("cleared_price").isNotNull() != (c("is_winner") == 1)),
            ("rule_cleared_above_bid", "cleared_price", c("cleared_price") > c("bid_cpm")),
        ],
        "impressions": [
            ("rule_latency_null_iff_not_rendered", "render_latency_ms", c("render_latency_ms").isNull() != ~is_true(c("rendered"))),
            ("rule_billable_not_rendered", "billable", is_true(c("billable")) & ~is_true(c("rendered"))),
            ("rule_revenue_without_billing", "revenue_usd", ~is_true(c("billable")) & (F.coalesce(c("revenue_usd"), F.lit(0.0)) != 0.0)),
            ("rule_complete_ts_null_iff_not_rendered", "render_complete_ts", c("render_complete_ts").isNull() != ~is_true(c("rendered"))),
        ],
    }


def contract_check(t: AdTables) -> DataFrame:
    """Primary-key duplicates and NULLs, foreign-key orphans, NULL count
    per column and the conditional rules of the model; one row per check
    with its violation count (0 = holds).

    Every check is an exact distributed aggregate: a key is checked by a
    ``groupBy`` on it, orphans by counts per key that meet the parent in a
    ``left_anti`` join, NULLs and row rules by one pass per table. Bids are
    shuffled once, by bid_id, for their key and the winning-bid rules; of a
    bid_id that occurs twice, every copy counts that breaks a rule. A repeated
    buyer_id counts as a duplicate only; its impressions are checked once.
    """
    tables = t.as_dict()
    parts: list[DataFrame] = []
    for name, key in PRIMARY_KEYS.items():
        df = tables[name]
        if name == "bids":
            continue  # with the winning bids below: one shuffle on bid_id serves both
        dup = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
        parts.append(dup.agg(*_row("pk_duplicate", name, key, F.coalesce(F.sum(F.col("c") - 1), F.lit(0)))))
    for child, ck, parent, pk in FOREIGN_KEYS:
        if (child, ck) == ("impressions", "winning_bid_id"):
            continue  # one left join below covers this key and its rules
        # counted per key first: a hot key is one row before any join
        kids = tables[child].filter(F.col(ck).isNotNull()).groupBy(ck).agg(F.count(F.lit(1)).alias("c"))
        orphans = kids.join(tables[parent].select(F.col(pk).alias(ck)), ck, "left_anti")
        parts.append(orphans.agg(*_row("fk_orphan", child, ck, F.coalesce(F.sum("c"), F.lit(0)))))
    rules = _rules(t)
    for name, df in tables.items():
        model_cols = [cn for cn in df.columns if cn != t.time_partition]  # the partition column is layout, not data
        cols = [F.struct(*_row("null_count", name, cn, count_if(F.col(cn).isNull()))) for cn in model_cols]
        cols += [F.struct(*_row(chk, name, cn, count_if(p))) for chk, cn, p in rules.get(name, [])]
        parts.append(df.agg(F.array(*cols).alias("_r")).select(F.inline("_r")))
    # On the bid id alone: this verifies the same-request guarantee rather than assuming it.
    one = ("request_id", "is_winner", "bid_ttl_ms", "cleared_price", "buyer_id")
    # A task keeps its bids in several hash tables by id, so the tasks follow the bids' number.
    n = max(default_buckets(t.bids.sparkSession), -(-t.bids.count() // TASK_BIDS))
    copies = t.bids.filter(F.col("bid_id").isNotNull()).select("bid_id", *one).repartition(n, "bid_id").groupBy("bid_id", *one).agg(F.count(F.lit(1)).alias("c"))
    by_id = copies.groupBy("bid_id").agg(F.sum("c").alias("c"))
    parts.append(by_id.agg(*_row("pk_duplicate", "bids", "bid_id", F.coalesce(F.sum(F.col("c") - 1), F.lit(0)))))
    bids = copies.select(
        F.col("bid_id").alias("winning_bid_id"), F.col("request_id").alias("_bid_req"), "is_winner",
        "bid_ttl_ms", "cleared_price", "buyer_id", F.col("c").alias("_copies"),
    )
    x = t.impressions.select(
        "winning_bid_id", "request_id", "rendered", "render_latency_ms", "viewable", "video_completed", "billable", "revenue_usd"
    ).filter(F.col("winning_bid_id").isNotNull())
    # one row per buyer, so that a repeated one does not repeat its impressions
    types = t.buyers.groupBy("buyer_id").agg(F.collect_set("billing_type").alias("_types"))
    x = x.join(bids, "winning_bid_id", "left").join(bounded_broadcast(types), "buyer_id", "left")
    # The billing rule: billable <=> rendered, rendered within the bid TTL, and
    # the buyer's billing signal present (viewable / completed / rendered).
    # A buyer listed with several types breaks it where any of them does.
    in_time = F.col("rendered") & (F.col("render_latency_ms") <= F.col("bid_ttl_ms"))

    def off(billing_type: Column) -> Column:
        signal = _billing_signal(billing_type, F.col("viewable"), F.col("video_completed"))
        return is_true(in_time & is_true(signal)) != is_true(F.col("billable"))

    known = F.coalesce(F.size("_types") > 0, F.lit(False))
    mismatch = F.when(known, F.exists("_types", off)).otherwise(is_true(F.col("billable")))
    rev_off = F.abs(F.col("revenue_usd") - F.col("cleared_price") / 1000.0) > F.lit(1e-6)
    checks = [
        ("fk_orphan", "winning_bid_id", F.col("_copies").isNull()),
        ("rule_winning_bid_other_request", "winning_bid_id", F.col("_bid_req") != F.col("request_id")),
        ("rule_winning_bid_not_winner", "winning_bid_id", F.col("is_winner") != 1),
        ("rule_billing_mismatch", "billable", mismatch),
        ("rule_revenue_not_cleared_price", "revenue_usd", is_true(F.col("billable")) & F.col("revenue_usd").isNotNull() & rev_off),
    ]
    broken = lambda p: F.coalesce(F.sum(F.when(p, F.coalesce("_copies", F.lit(1)))), F.lit(0))
    parts.append(x.agg(F.array(*[F.struct(*_row(n, "impressions", cn, broken(p))) for n, cn, p in checks]).alias("_r")).select(F.inline("_r")))
    # video_completed is NULL exactly on non-video formats (request_id join: bucket-aligned)
    v = t.impressions.select("request_id", "video_completed").join(t.ad_requests.select("request_id", "ad_format"), "request_id")
    no_video = F.col("ad_format").isin("banner", "native")
    parts.append(v.agg(*_row("rule_video_null_iff_not_video_format", "impressions", "video_completed", count_if(F.col("video_completed").isNull() != no_video))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
