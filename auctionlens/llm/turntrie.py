"""Operator 11: the trie of conversation prefixes, by ROLLUP over turn-id columns.

A turn's id is two 64-bit hashes of its role and text (with the number of its
words). Each conversation becomes rows of ``width`` positional columns t1, t2
...: the first row holds its first turns, and a longer conversation continues
in further blocks, each keyed by the node that the block before ends in. A
node is named by two 64-bit digests of its (position, turn id) pairs, joined by
exclusive or, so that a block's key and a node's parent come from a running
aggregate and no step follows another by depth. Then

1. ``GROUP BY block, key, ROLLUP (t1, ...)`` with grouping_id gives every
   prefix of every conversation at once: its smallest member, its members.
2. Children are counted by parent. A node is owned by its smallest member;
   the nodes that a conversation owns are a suffix of its path. So what a
   subtree adds up to is what its members own in all, without what the top's
   owner owns above the top: a second ROLLUP over the same rows, with each
   conversation's own total, gives all subtree sums. No walk over the levels.
3. Members that end in a node are joined to strings of one id range (``RANGE``)
   first; a task then feeds a node's strings, in order, to one SHA-256.

Hot groups: prefixes that many conversations share are aggregated on the map
side; a parent of many nodes only meets them in an inner or left sort-merge
join that adaptive execution splits. One conversation's turns (ids, not
texts) are sorted in one task, which spills; SHA-256 over a node's ids is
sequential by its nature, but takes strings of up to ``RANGE`` ids one at a time.

Defined cases: rows without a conv_id belong to no conversation; null turns come
first, null roles and texts are empty; turns of equal number are ordered by
role, then by turn id; repeated rows are turns of their own; conversations
without turns (after rebuilding) are members of the root alone; an empty table
has no nodes, not even the root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WIDTH = 8
RANGE = 16  # bits of conv_id within one string of ending members
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

ORACLE = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda s, x: list_reduce([CAST(i AS BIGINT) FOR i IN range(8)], lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(s, x)),
    CAST(4294967295 AS BIGINT))) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)),
seq AS (
  SELECT ids.c, 0 AS part, t.p, t.role, t.text FROM ids JOIN turns t ON t.c = ids.c - ids.c % 20 AND t.p <= ids.h
  UNION ALL SELECT ids.c, 1, t.p, t.role, t.text FROM ids JOIN turns t ON t.c = ids.c AND t.p > ids.h),
paths AS (
  SELECT ids.c, coalesce(s.path, []) AS path, coalesce(s.words, []) AS words FROM ids LEFT JOIN (
    SELECT c, list(md5(role || chr(10) || text) || length(role) ORDER BY part, p) AS path,
           list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, p) AS words
    FROM seq GROUP BY c) s ON s.c = ids.c),
steps AS (SELECT c, path, words, unnest(range(len(path) + 1)) AS d FROM paths),
nodes AS (
  SELECT path[:d] AS node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN words[d] ELSE 0 END) AS w,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(path) = d), '')) AS ends_sha256
  FROM steps GROUP BY path[:d], d),
kids AS (SELECT node[:d - 1] AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
up AS (
  SELECT n.node[:a] AS node, a AS d, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM (SELECT node, d, n_convs, w, unnest(range(d + 1)) AS a FROM nodes) n LEFT JOIN kids k ON k.node = n.node AND k.d = n.d GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN up u ON u.node = n.node AND u.d = n.d LEFT JOIN kids k ON k.node = n.node AND k.d = n.d
LEFT JOIN nodes p ON p.d = n.d - 1 AND n.d > 0 AND p.node = n.node[:n.d - 1]
"""


def turn_ids(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, p, a, b, w): the ids and words of each conversation's turns,
    p from 0. The texts themselves are not shuffled."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    ids = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        who.alias("role"),
        F.xxhash64(who, what).alias("a"),
        F.xxhash64(F.lit(11), what, who).alias("b"),
        F.regexp_count(what, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("w"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first())
    return ids.select("conv_id", (F.row_number().over(order) - 1).alias("p"), "a", "b", "w")


def _marks(turns: DataFrame) -> DataFrame:
    """One row without a turn for each conversation, ahead of its turns."""
    none = F.lit(None).cast("bigint")
    return turns.filter("p = 0").select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("p"), none.alias("a"), none.alias("b"), none.alias("w"))


def whole(turns: DataFrame) -> DataFrame:
    """The sequences (conv_id, part, p, a, b, w) of the conversations as they are."""
    turns = stored(turns, "trie-turns")
    return _marks(turns).unionByName(turns.withColumn("part", F.lit(1)))


def rebuilt(turns: DataFrame, share: int = 20, heads: int = 4) -> DataFrame:
    """The sequences in which a conversation c takes its first h turns from
    conversation c - c % ``share``; h is crc32(c as text) % ``heads``. At most
    2 * ``share`` - 1 conversations take from one."""
    turns = stored(turns, "trie-turns")
    own, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    first = turns.filter((own % share == 0) & (F.col("p") < heads - 1)).withColumnRenamed("conv_id", "base")
    taken = turns.filter("p = 0").select("conv_id", h, (own - own % share).alias("base")).join(first, "base").filter("p < h")
    rest = turns.select("*", h).filter("p >= h")
    parts = [taken.withColumn("part", F.lit(0)), rest.withColumn("part", F.lit(1))]
    return reduce(DataFrame.unionByName, [_marks(turns), *(x.select("conv_id", "part", "p", "a", "b", "w") for x in parts)])


def _step(pos: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """What a turn adds to the digests of a prefix (nothing, if there is none)."""
    pos = pos.cast("bigint")
    return tuple(F.when(a.isNotNull(), h).otherwise(F.lit(0).cast("bigint")) for h in (F.xxhash64(pos, a, b), F.xxhash64(F.lit(5), b, pos, a)))


def blocks(sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each conversation and block: k, its key (k1, k2), t1 ... as
    (a, b, w) or null, and where the conversation ends (e1, e2), in its last."""
    turns = Window.partitionBy("conv_id").orderBy("part", "p")  # no nulls
    so_far = turns.rowsBetween(Window.unboundedPreceding, 0)
    x = sequences.withColumn("pos", F.row_number().over(turns) - 1)
    x1, x2 = _step(F.col("pos"), F.col("a"), F.col("b"))
    x = x.withColumns({"x1": x1, "x2": x2})
    x = x.withColumns({"d1": F.bit_xor("x1").over(so_far), "d2": F.bit_xor("x2").over(so_far), "last": F.lead("pos").over(turns).isNull()})
    x = x.withColumn("k", F.greatest(F.lit(0), F.floor((F.col("pos") - 1) / width)).cast("bigint"))
    x = x.withColumn("j", F.col("pos") - F.col("k") * width)
    at = [F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{c}{j}") for j in range(1, width + 1) for c in ("a", "b", "w")]
    key = [F.coalesce(F.max(F.when(F.col("j") == 1, F.col(f"d{i}").bitwiseXOR(F.col(f"x{i}")))), F.lit(0).cast("bigint")).alias(f"k{i}") for i in (1, 2)]
    ends = [F.max(F.when(F.col("last"), F.col(f"d{i}"))).alias(f"e{i}") for i in (1, 2)]
    packed = [F.when(F.col(f"a{j}").isNotNull(), F.struct(F.col(f"a{j}").alias("a"), F.col(f"b{j}").alias("b"), F.col(f"w{j}").alias("w"))).alias(f"t{j}") for j in range(1, width + 1)]
    return x.groupBy("conv_id", "k").agg(*key, *at, *ends).select("conv_id", "k", "k1", "k2", *packed, "e1", "e2")


def _rollup(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """``aggregates`` of every prefix: digests n1, n2, parent's p1, p2, depth, w."""
    columns = ", ".join(f"t{j}" for j in range(1, width + 1))
    sql = f"SELECT k, k1, k2, {columns}, {width} - bit_count(grouping_id()) AS d, {aggregates} FROM {{rows}} GROUP BY k, k1, k2, ROLLUP ({columns})"
    out = rows.sparkSession.sql(sql, rows=rows)
    # a conversation that is shorter than d makes no node of depth d; a block's
    # key is a node of the block before
    there = reduce(Column.__add__, [F.col(f"t{j}").isNotNull().cast("int") for j in range(1, width + 1)])
    out = out.filter((there == F.col("d")) & ((F.col("d") > 0) | (F.col("k") == 0)))
    steps = [_step(F.col("k") * width + j, F.col(f"t{j}.a"), F.col(f"t{j}.b")) for j in range(1, width + 1)]
    above = [[F.when(F.col("d") > j, s[i]).otherwise(F.lit(0).cast("bigint")) for j, s in enumerate(steps, 1)] for i in (0, 1)]
    return out.select(
        *[reduce(Column.bitwiseXOR, [s[i] for s in steps], F.col(f"k{i + 1}")).alias(f"n{i + 1}") for i in (0, 1)],
        *[reduce(Column.bitwiseXOR, above[i], F.col(f"k{i + 1}")).alias(f"p{i + 1}") for i in (0, 1)],
        (F.col("k") * width + F.col("d")).alias("depth"),
        F.coalesce(*[F.col(f"t{j}.w") for j in range(width, 0, -1)], F.lit(0)).alias("w"),
        *[c for c in out.columns if c not in ("k", "k1", "k2", "d") and c[0] != "t"],
    )


def _ends(rows: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of the nodes in which conversations end."""
    ended = rows.filter("e1 is not null").select(F.col("e1").alias("n1"), F.col("e2").alias("n2"), "conv_id", F.shiftright("conv_id", RANGE).alias("part"))
    ids = F.sort_array(F.collect_list("conv_id"))  # at most 2 ** RANGE
    lists = ended.groupBy("n1", "n2", "part").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        key, digest = None, None
        for b in batches:
            done = []
            for n1, n2, ids in zip(b.column("n1").to_pylist(), b.column("n2").to_pylist(), b.column("ids"), strict=True):
                if (n1, n2) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (n1, n2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield _table(done)
        if key is not None:
            yield _table([(*key, digest.hexdigest())])

    def _table(done):
        n1, n2, sha = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(n1, pa.int64()), pa.array(n2, pa.int64()), pa.array(sha, pa.string())], names=["n1", "n2", "ends_sha256"])

    return lists.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "part").mapInArrow(run, "n1 bigint, n2 bigint, ends_sha256 string")


def trie(sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each node of the trie of ``sequences`` (see ``whole``)."""
    rows = stored(blocks(sequences, width), "trie-blocks")
    nodes = stored(_rollup(rows, width, "min(conv_id) AS conv_id, count(*) AS n_convs"), "trie-nodes")
    key = ["n1", "n2"]
    kids = nodes.filter("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, key, "left").fillna(0, ["n_children"]).withColumn("saved", (F.col("n_convs") - 1) * F.col("w"))
    nodes = stored(nodes, "trie-counted")

    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("own_saved"), F.count_if(F.col("n_children") == 0).alias("own_leaves"))
    sums = _rollup(rows.join(owned, "conv_id", "left"), width, "sum(own_saved) AS all_saved, sum(own_leaves) AS n_leaves").select(*key, "all_saved", "n_leaves")
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)  # of one conversation's path
    out = nodes.withColumn("above", F.coalesce(F.sum("saved").over(above), F.lit(0))).join(sums, key).join(_ends(rows), key, "left")
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    return out.join(parents, ["p1", "p2", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("all_saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, width: int = WIDTH, **names: str) -> DataFrame:
    """The trie of a table of turns; ``names``: its columns, see ``turn_ids``."""
    return trie(whole(turn_ids(conversations, **names)), width)


def op11(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with shared first turns."""
    return trie(rebuilt(turn_ids(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
