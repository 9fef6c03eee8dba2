"""Operator 4: approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted in numpy on a bounded sample (``sample_rows`` vectors,
scaled to length 1): k-means with ``BRANCH`` centres, again inside each
cluster, down to ``LEAF`` sample vectors. Every vector of the table is put
in a leaf. A query walks the tree best bin first: a priority queue holds the
nodes seen by their distance, the nearest is opened, leaves are visited in
the order they come out. How many leaves are visited is calibrated: the true
neighbours of ``CALIBRATION`` sample vectors are found among all rows, and
the smallest number of leaves that holds ``target`` of them is taken. A query widens further until its leaves hold at least
``4 * k`` vectors.

Queries meet the vectors of their leaves in blocks: a leaf with more than
``BLOCK`` vectors or queries is split on both sides, so a very common vector
does not fill one task; each task keeps k rows a query, and the last ranking
reads only those. Similarities are preselected by a matrix product
and then computed in double precision, in one fixed order, from the original
vectors, so equal vectors tie exactly.

Defined cases: vectors that are null, zero, hold a null or non-finite number
or are not of the table's most common length take no part; a vec_id that is
repeated counts once as a candidate, with its best score; ties go to the
smaller vec_id; an empty table has no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_sample, stored, stream_groups

BRANCH = 8
LEAF = 256
SAMPLE_ROWS = 20_000
CALIBRATION = 300
BLOCK = 4096
MERGE_ROWS = 200_000


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=np.float64)
    top = np.abs(v).max(1, keepdims=True)
    v = v / np.where(top > 0, top, 1)  # no overflow in the squares
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
        for j in range(k):
            if (at == j).any():
                c[j] = x[at == j].mean(0)
    return c


def build(sample: np.ndarray, seed: int = 3) -> dict:
    """Tree over unit vectors: per node its centre and children; a node
    without children is a leaf."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if sample.size else 1
    centres, children, leaf_of, leaves = [np.zeros(dim)], [[]], [-1], 0
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        x = sample[rows]
        parts = []
        if len(rows) > LEAF:
            c = _kmeans(x, BRANCH, rng)
            at = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
            parts = [(c[j], rows[at == j]) for j in range(BRANCH) if (at == j).any()]
        if len(parts) < 2:  # equal vectors can't be parted
            leaf_of[node], leaves = leaves, leaves + 1
            continue
        for c, sub in parts:
            children[node].append(len(centres))
            todo.append((len(centres), sub))
            centres.append(c)
            children.append([])
            leaf_of.append(-1)
    return {"centres": np.array(centres), "children": [np.array(x, int) for x in children], "leaf_of": leaf_of, "leaves": leaves}


def assign(tree: dict, x: np.ndarray) -> np.ndarray:
    """Leaf of each unit vector, by the nearest child at each level."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        kids = tree["children"][node]
        if not len(kids):
            out[rows] = tree["leaf_of"][node]
            continue
        c = tree["centres"][kids]
        at = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, 1)
        todo += [(int(kids[j]), rows[at == j]) for j in range(len(kids)) if (at == j).any()]
    return out


def leaf_order(tree: dict, q: np.ndarray):
    """Leaves in best-bin-first order of one unit vector."""
    queue = [(0.0, 0)]
    while queue:
        _, node = heapq.heappop(queue)
        kids = tree["children"][node]
        if not len(kids):
            yield tree["leaf_of"][node]
            continue
        d = ((tree["centres"][kids] - q) ** 2).sum(1)
        for j in range(len(kids)):
            heapq.heappush(queue, (float(d[j]), int(kids[j])))


def calibrate(indexed: DataFrame, tree: dict, ids: np.ndarray, unit: np.ndarray, k: int, target: float) -> int:
    """Smallest number of leaves that holds a ``target`` share of the true
    nearest neighbours of a bounded set of vectors, found by comparing those
    with every row of the table."""
    picks = np.arange(0, len(ids), max(1, len(ids) // CALIBRATION))[:CALIBRATION]
    if not len(picks):
        return 1
    q, own = unit[picks], ids[picks]

    def nearest(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                x = b.slice(lo, BLOCK)
                rid, leaf = x.column(0).to_numpy(), x.column(3).to_numpy()
                s = q @ _unit(_array(x.column(2))).T
                s[own[:, None] == rid[None, :]] = -np.inf
                n = min(k, s.shape[1])
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                at = np.repeat(np.arange(len(own)), n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rid[top.ravel()]), pa.array(s[at, top.ravel()]), pa.array(leaf[top.ravel()])], names=["q", "id", "s", "leaf"])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    found = indexed.mapInArrow(nearest, "q bigint, id bigint, s double, leaf bigint").filter("s > -2")
    rows = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "leaf").collect()  # at most k * CALIBRATION
    if not rows:
        return 1
    rank = {}
    needed = []
    for r in rows:
        if r["q"] not in rank:
            rank[r["q"]] = {leaf: i + 1 for i, leaf in enumerate(leaf_order(tree, q[r["q"]]))}
        needed.append(rank[r["q"]][r["leaf"]])
    return int(np.quantile(needed, target, method="higher"))


def _usable(embedding: Column) -> Column:
    v = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each query, ties to the smaller vec_id; a
    vec_id counts once a query."""
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[first], v[first], s[first]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
    top = rank < k
    return q[top], v[top], s[top]


def _array(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(table: DataFrame, is_query: Column, k: int = 5, target: float = 0.95, sample_rows: int = SAMPLE_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row that ``is_query`` picks, its ``k`` nearest other rows found:
    query_id, rank, vec_id, score (cosine)."""
    rows = table.filter(F.col(vec_id).isNotNull() & _usable(F.col(embedding))).select(F.col(vec_id).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(embedding).cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 1
    rows = rows.filter(F.size("v") == dim)
    sample = hash_sample(rows.select("id", "v"), "id", sample_rows).toPandas()
    unit = _unit(np.array(sample["v"].tolist()).reshape(len(sample), dim)) if len(sample) else np.zeros((0, dim))
    tree = build(unit)

    def index(batches):
        for b in batches:
            if b.num_rows:
                leaf = assign(tree, _unit(_array(b.column(2))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["id", "query", "v", "leaf"])

    indexed = stored(rows.mapInArrow(index, "id bigint, query boolean, v array<double>, leaf bigint"), "kmtree-index")
    visits = calibrate(indexed, tree, sample["id"].to_numpy(), unit, k, target)
    size = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # at most as many as the tree's leaves
    count = np.array([size.get(i, 0) for i in range(tree["leaves"])])

    def visit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at, leaves = [], []
            for i, q in enumerate(_unit(_array(b.column(1)))):
                seen = 0
                for n, leaf in enumerate(leaf_order(tree, q)):
                    if n >= visits and seen >= 4 * k:
                        break
                    seen += count[leaf]
                    if count[leaf]:
                        at.append(i)
                        leaves.append(leaf)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(leaves, pa.int64())], names=["id", "v", "leaf"])

    asked = stored(indexed.filter("query").select("id", "v").mapInArrow(visit, "id bigint, v array<double>, leaf bigint"), "kmtree-visits")
    wanted = asked.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("qb"))
    blocks = wanted.join(indexed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("vb")), "leaf")
    blocks = F.broadcast(blocks)  # at most as many rows as the tree's leaves

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(n):
        return F.pmod(F.xxhash64("id", F.lit(11)), F.col(n)).cast("int")

    q = asked.join(blocks, "leaf").select("leaf", own("qb").alias("i"), every("vb").alias("j"), F.lit(1).alias("side"), "id", "v")
    c = indexed.join(blocks, "leaf").select("leaf", every("qb").alias("i"), own("vb").alias("j"), F.lit(0).alias("side"), "id", "v")
    grid = q.unionByName(c).repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")

    def compare(batches):
        kept, size = [], 0
        for t in stream_groups(batches, ("leaf", "i", "j")):
            side, ids = t.column("side").to_numpy() == 1, t.column("id").to_numpy()
            if not side.any() or side.all():
                continue
            v = _array(t.column("v"))
            norm, unit_v = np.sqrt((v * v).sum(1)), _unit(v)
            qs, cs = np.flatnonzero(side), np.flatnonzero(~side)
            for a in range(0, len(qs), 256):
                part = qs[a : a + 256]
                near = unit_v[part] @ unit_v[cs].T
                near[ids[part][:, None] == ids[cs][None, :]] = -np.inf
                least = np.partition(near, len(cs) - k, axis=1)[:, len(cs) - k] if len(cs) > k else np.full(len(part), -2.0)
                row, col = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
                row, col = part[row], cs[col]
                exact = (v[col] * v[row]).sum(1) / (norm[col] * norm[row])
                odd = ~np.isfinite(exact)
                if odd.any():  # squares out of range
                    exact[odd] = (unit_v[col[odd]] * unit_v[row[odd]]).sum(1)
                kept.append((ids[row], ids[col], exact))
                size += len(row)
            if size > MERGE_ROWS:  # what the task has found so far, k rows a query
                kept = [_best(*map(np.concatenate, zip(*kept, strict=True)), k)]
                size = len(kept[0][0])
                if size > MERGE_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], names=["query_id", "vec_id", "score"])
                    kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(*map(np.concatenate, zip(*kept, strict=True)), k)], names=["query_id", "vec_id", "score"])

    found = grid.mapInArrow(compare, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
