"""Source lint: every sort names its NULL placement (PostgreSQL sorts NULLs
last on ASC, Spark first), and no Python UDF appears in the library."""

from __future__ import annotations

import re
from pathlib import Path

PKG = Path(__file__).resolve().parents[1] / "auctionlens"
# the ad-yield library; the optional text operators have their own rules
FILES = [f for f in PKG.rglob("*.py") if f.parent.name != "llm"]


def _calls(src: str, name: str):
    for m in re.finditer(rf"{name}\(", src):
        depth, i = 1, m.end()
        while depth and i < len(src):
            depth += {"(": 1, ")": -1}.get(src[i], 0)
            i += 1
        yield src[m.end() : i - 1]


def test_every_sort_names_null_placement():
    bad = []
    for f in FILES:
        src = f.read_text()
        for args in _calls(src, "orderBy"):
            for arg in [a.strip() for a in re.split(r",(?![^(]*\))", args) if a.strip()]:
                ok = "nulls_last" in arg or "nulls_first" in arg or arg in ("order", "*order")
                if not ok:
                    bad.append(f"{f.name}: {arg}")
    assert bad == []


def test_no_python_udfs_in_library():
    for f in FILES:
        src = f.read_text()
        assert not re.search(r"\bF\.udf\b|@udf\b|pandas_udf|applyInPandas|mapInPandas|\.rdd\b", src), f.name
