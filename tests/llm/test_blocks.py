"""The blocks of operator 5 and what the driver loads for it."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from auctionlens.llm import setsketch


def test_blocks_are_dealt_in_one_pass(spark):
    """Each row of a group meets each row outside its largest component in one
    block, and the rows that are dealt are computed once."""
    rows = [(1, i, 0 if i < 6 else i, 0, 3) for i in range(10)]
    left = spark.createDataFrame(rows, "key long, id long, comp long, big long, nb int")
    cells = setsketch._cells(left, ["key", "id", "comp"])
    assert "Union" not in cells._jdf.queryExecution().optimizedPlan().toString()
    ones, alls = cells.filter("side = 1"), cells.filter("side = 0")
    assert ones.count() == 4 * 3 and alls.count() == 10 * 3
    met = ones.select("i", "j", F.col("id").alias("a")).join(alls.select("i", "j", F.col("id").alias("b")), ["i", "j"])
    assert sorted((r.a, r.b) for r in met.collect()) == [(a, b) for a in range(6, 10) for b in range(10)]


def test_the_entry_loads_no_pandas():
    """The driver's memory is scarce where operators run with many steps."""
    root = Path(__file__).resolve().parents[2]
    code = "import sys, __spark_entry__; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
