"""Connected components of a link table, by large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each
round links every node's larger neighbours to its smallest one, then its
smaller neighbours, until nothing changes; the number of rounds is
logarithmic in practice. Links stay in Spark; each round starts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stored

#: links that one task of a round's last step takes at most, about
TASK_LINKS = 500_000


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` (a, b) to (node, root): the smallest node that each node
    with a link to another one reaches."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before, tasks = None, None
    while True:
        # count and hash of the links are taken while they are written
        seen = Observation()
        e = e if tasks is None else e.coalesce(tasks)
        e = stored(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
        state = (seen.get["n"], seen.get["h"])
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, tasks = state, 1 + state[0] // TASK_LINKS
        # both stars keep the larger node first
        e = _small(_large(e))
