"""Every registered query against its independent DuckDB SQL, on sf0.001.

The driver runs the same comparison at sf0.01 (tools/compare.py does too).
"""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from auctionlens import oracle
from compare import duck, frame_hash

from conftest import SF0001

KEYS = sorted(k for k in E.queries() if k in oracle.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_every_query_has_an_oracle():
    optional = {k for k in E.queries() if k == "pipeline" or k.startswith("op")}  # tested in tests/llm
    assert set(oracle.QUERIES) == set(E.queries()) - optional
    assert set(oracle.QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sp = E.queries()[key](spark, SF0001).toPandas()
    dk = con.execute(E.oracle_sql()[key]).fetchdf()
    assert frame_hash(sp) == frame_hash(dk)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["d", "bid_rate", "win_rate", "render_rate", "billable_rate", "ecpm", "ecpm_7d_avg"]
    assert df.count() > 0
