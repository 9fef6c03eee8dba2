"""Run the investigation from the command line.

    python -m auctionlens --tables /data/adtables --hinge 2026-05-20 [--out /results]
    python -m auctionlens --testdata /root/testdata/sf0.1 [--only funnel_daily,error_trail]

``--tables`` reads reference-shaped parquet (one folder per table:
ad_requests, bids, impressions, sdk_events, buyers, publishers) with the
fixed schemas; ``--testdata`` derives the six tables from the TPC-H-shaped
testdata. Each result is shown, and with ``--out`` also written as parquet
under ``{out}/{name}`` (overwrite, so a rerun replaces it).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame

from auctionlens.functions.naming import reference_names
from auctionlens.operators import cohorts, decompose, funnel, guardrail, impact, mechanism, quality
from auctionlens.sources.schema import REFERENCE_ROW_COUNTS, AdTables


def report(t: AdTables, hinge: str, base: str, cand: str, expected_counts: dict | None) -> dict[str, Callable[[], DataFrame]]:
    """The nine reference result sets, the load check and the derived analyses."""
    v = {"hinge": hinge}
    vv = {**v, "base": base, "cand": cand}
    return {
        "load_verification": lambda: quality.load_verification(t.as_dict(), expected_counts),
        "funnel_daily": lambda: funnel.funnel_daily(t),
        "ecpm_decomposition": lambda: decompose.ecpm_decomposition(t, **v),
        "geo_mix_control": lambda: decompose.geo_mix_control(t, **v),
        "cohort_version_compare": lambda: cohorts.cohort_version_compare(t, **vv),
        "stratified_compare": lambda: cohorts.stratified_compare(t, **vv),
        "latency_vs_ttl": lambda: mechanism.latency_vs_ttl(t, **v),
        "billing_type_split": lambda: mechanism.billing_type_split(t, **vv),
        "error_trail": lambda: mechanism.error_trail(t, hinge=hinge, cand=cand),
        "counterfactual_impact": lambda: impact.counterfactual_impact(t, **vv),
        "cohort_pre_post": lambda: cohorts.cohort_pre_post(t, **v),
        "ecpm_attribution": lambda: decompose.ecpm_attribution(t, **v),
        "mix_standardized": lambda: decompose.mix_standardized(t, **v),
        "leak_stage": lambda: funnel.leak_stage(t, **v),
        "control_diff": lambda: cohorts.control_diff(t, **vv),
        "decline_onset": lambda: funnel.decline_onset(t, **v),
        "rollout_adoption": lambda: funnel.rollout_adoption(t, cand=cand),
        "error_rate_vs_control": lambda: mechanism.error_rate_vs_control(t, **vv),
        "relative_loss": lambda: impact.relative_loss(t, **vv),
        "exposure": lambda: impact.exposure(t, **vv),
        "ttl_what_if": lambda: impact.ttl_what_if(t, hinge=hinge, cand=cand),
        "publisher_scope": lambda: funnel.publisher_scope(t, **v),
        "guardrail_first_alert": lambda: guardrail.guardrail_first_alert(t, hinge=hinge, base=base, cand=cand),
        "contract_check": lambda: quality.contract_check(t),
    }


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="auctionlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder of reference-shaped parquet tables")
    src.add_argument("--testdata", help="testdata scale-factor folder (derived tables)")
    ap.add_argument("--hinge", help="before/after date (default: 2026-05-20, or 1998-07-01 for testdata)")
    ap.add_argument("--base", default=funnel.BASE)
    ap.add_argument("--cand", default=funnel.CAND)
    ap.add_argument("--only", default="", help="comma-separated result names")
    ap.add_argument("--out", help="write each result as parquet under this folder")
    ap.add_argument("--rows", type=int, default=20, help="rows to show per result")
    ap.add_argument("--reference-names", action="store_true", help="name version columns after the versions (n_v81, br_v82)")
    ap.add_argument("--explain", action="store_true", help="print each result's formatted physical plan instead of running it")
    ap.add_argument("--store", help="with --tables: first lay the tables out for scale under this folder (bucketed, day-partitioned)")
    args = ap.parse_args(argv)

    from auctionlens.plans.inspect import formatted_plan
    from auctionlens.plans.session import get_session
    from auctionlens.sources.fixtures import FIXTURE_HINGE, fixture_tables
    from auctionlens.sources.tables import load_reference_tables, store_tables

    spark = get_session()
    if args.tables:
        t, hinge, expected = load_reference_tables(spark, args.tables), args.hinge or funnel.REFERENCE_HINGE, REFERENCE_ROW_COUNTS
        if args.store:
            t = store_tables(t, args.store)
    else:
        hinge = args.hinge or FIXTURE_HINGE
        t, expected = fixture_tables(spark, args.testdata, hinge=hinge), None
    results = report(t, hinge, args.base, args.cand, expected)
    names = [n for n in args.only.split(",") if n] or list(results)
    for name in names:
        df = results[name]()
        if args.reference_names:
            df = reference_names(df, args.base, args.cand)
        print(f"== {name}")
        if args.explain:
            print(formatted_plan(df))
            continue
        df.show(args.rows, truncate=False)
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
