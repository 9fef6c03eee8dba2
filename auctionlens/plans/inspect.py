"""Physical-plan inspection: what a Spark user reads in ``explain('formatted')``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def formatted_plan(df: DataFrame) -> str:
    """``df.explain('formatted')`` as a string, with pushed filters and other
    metadata untruncated."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", prev)


def exchanges(df: DataFrame) -> list[str]:
    """Partitionings of every shuffle in the physical plan (broadcasts excluded)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange (hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|SinglePartition|RoundRobinPartitioning\([^)]*\))", plan)
    return [re.sub(r"#\d+L?", "", e) for e in found]


def python_nodes(df: DataFrame) -> list[str]:
    """Python evaluation nodes in the plan (empty for an all-JVM plan)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [n for n in PYTHON_NODES if n in plan]


def hash_partitioned_on(df: DataFrame, column: str, partitions: int) -> bool:
    """True when the physical plan's output is hash-partitioned on exactly
    ``column`` into ``partitions`` partitions (e.g. a bucketed scan or join,
    or an explicit repartition), so a bucketed write needs no new shuffle."""
    try:
        plan = df._jdf.queryExecution().executedPlan()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.inputPlan()  # the planned tree, exchanges included, before runtime re-planning
        text = plan.outputPartitioning().toString()
    except Exception:  # noqa: BLE001  (not provable: take the safe path)
        return False
    m = re.fullmatch(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", text.strip())
    return bool(m) and m.group(1) == column and int(m.group(2)) == partitions
