"""Operator 5: near-duplicates by SetSketch registers.

Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog" (2021).
A document is the set of its distinct word shingles. Each of ``M`` registers
holds floor(1 - log_b(x)), cut to 0 ... q + 1, where x is the smallest of
the shingles' exponential(a) values; with b near 1 registers agree with
almost the sets' Jaccard similarity, and sketches of a union are the larger
registers. Steps:

1. One pass over the texts makes set size, a 128-bit set hash and the
   registers. Equal sets become one class, stood for by the smallest id.
2. ``BANDS`` bands of ``ROWS`` registers give bucket keys. Two sets with
   similarity 0.8 share no bucket with probability (1 - 0.8^5)^30 < 1e-5.
3. In each bucket one class (by the hash of id and key) is the hub. Each
   class is compared with the hubs of its buckets by the joint likelihood
   of the two sketches given both set sizes; in ``HUB_ROUNDS`` rounds the
   likeliest hub outside its component is verified on the full sets, and
   links join into components.
4. Buckets that still hold several components are compared in blocks: each
   class outside the bucket's largest component against the classes of other
   components, by the joint likelihood. What leaves the task is a forest over
   the block's components that joins those with an estimate within 4.5 standard
   errors of the threshold: fewer links than components. Joined over all
   buckets, these make groups outside of which there is nothing left to link.
5. In a group each class outside its largest component meets the classes of
   other components once more, in blocks, with its full set. Intersections are
   counted exactly and what leaves the task is again a forest, now of verified
   links. So links between two components that share a bucket are only lost
   where the estimate errs by more than 4.5 standard errors (the bands' loss
   stands above), copies are never paired with each other, and no list of pairs
   is made.

Full sets are made again from the texts of the classes in question only.
Hot buckets and groups: copies collapse before any join, hubs make work
linear in a bucket's size, blocks are bounded by rows (``BLOCK``) and by bytes
of full sets (``SET_BYTES``), joins on hubs are inner sort-merge joins that
adaptive execution splits.

Defined cases: documents without words or text have the empty set and link
with nothing; rows that share an id are one node; rows with a null id link
with nothing, have a null component and are kept; every input row gives one
output row; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, VISIBLE, filter_bits, gram_hashes, mix, passes, stored, stream_groups, text_blocks, tidy, word_hashes, words
from .components import components

ROWS, BANDS = 5, 30
M = ROWS * BANDS
BASE, RATE, Q = 1.001, 20.0, 65534
PERCENT = 80
CUT = PERCENT / 100 - 4.5 * float(np.sqrt(0.8 * 0.2 / M))
BLOCK = 2048
SET_BYTES = 1 << 24
HUB_ROUNDS = 2
SALTS = 8

_rng = np.random.default_rng(20210)
_XOR = _rng.integers(0, 1 << 32, M, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    return np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of hashes."""
    low = np.full(M, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 1024):
        y = (x[a : a + 1024, None] ^ _XOR) * _ODD
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(low, y.min(0), out=low)
    smallest = -np.log1p(-(low + 0.5) / 2.0**32) / RATE  # exponential from uniform
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def _band_keys(regs: np.ndarray) -> np.ndarray:
    r = regs.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, j])
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    """Probability that one register is above the other, by the share x of
    the union's elements that only the one set has."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likelihood_slope(above, below, na, nb, j: float):
    """Slope at ``j`` of the joint log likelihood of the Jaccard similarity;
    it falls in ``j``, so the estimate is at least ``j`` where it is not
    negative (or where ``j`` is more than the sizes allow: minus infinity)."""
    u, v = na / (na + nb), nb / (na + nb)
    step = 1e-4

    def ll(j):
        pa, pb = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
        return above * np.log(pa) + below * np.log(pb) + (M - above - below) * np.log(np.maximum(1 - pa - pb, 1e-12))

    return np.where(np.minimum(u, v) < j * np.maximum(u, v), -np.inf, ll(j) - ll(j - step))


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Largest grid point of the similarity that the likelihood still rises to."""
    above, below = (ra > rb).sum(1), (ra < rb).sum(1)
    best = np.zeros(len(ra))
    for j in np.arange(0.02, 1.0, 0.02):
        best = np.where(likelihood_slope(above, below, na, nb, j) >= 0, j, best)
    return best


def _documents(src: DataFrame, k: int) -> DataFrame:
    """id, text -> id, n, two set hashes, band keys, registers."""
    kind = src.schema[0].dataType.simpleString()
    names = ["id", "n", "s1", "s2", "keys", "regs"]

    def run(batches):
        for b in batches:
            n, s1, s2, keys, regs = [], [], [], [], []
            for lo, hi, raw, offs in text_blocks(b.column(1)):
                buf = LOWER[raw]
                starts, ends, rows = words(buf, offs, VISIBLE)
                h = word_hashes(buf, starts, ends)
                for r in range(hi - lo):
                    s = shingles(h[rows[r] : rows[r + 1]], k)
                    n.append(len(s))
                    s1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    s2.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    if len(s):
                        x = registers(s)
                        keys.append(_band_keys(x).tolist())
                        regs.append(x.tobytes())
                    else:
                        keys.append([])
                        regs.append(b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(regs, pa.binary())], names=names)

    return src.mapInArrow(tidy(run), f"id {kind}, n bigint, s1 bigint, s2 bigint, keys array<bigint>, regs binary")


def _matrix(column) -> np.ndarray:
    raw = b"".join(x.as_py() for x in column)
    return np.frombuffer(raw, np.uint16).reshape(-1, M)


def _estimated(pairs: DataFrame) -> DataFrame:
    """a, b, na, nb, ra, rb -> a, b, est"""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for x in batches:
            if x.num_rows:
                na, nb = x.column("na").to_numpy(), x.column("nb").to_numpy()
                est = estimate(_matrix(x.column("ra")), _matrix(x.column("rb")), na, nb)
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(est)], names=["a", "b", "est"])

    return pairs.mapInArrow(tidy(run), f"a {kind}, b {kind}, est double")


def _forest(label: np.ndarray, rows: np.ndarray, near):
    """Joins rows of different labels: yields (row, near row) for each label
    that ``near(row)`` still finds, and makes the labels one. So fewer links
    than labels, whatever the number of near rows."""
    for s in rows:
        hit = near(s)
        _, first = np.unique(label[hit], return_index=True)
        for other in hit[first]:
            if label[other] != label[s]:
                yield s, other
                label[label == label[other]] = label[s]


def _likely_forest(rows: DataFrame) -> DataFrame:
    """Rows (key, i, j, side, id, comp, n, regs), sorted by (key, i, j): links
    (a, b) of a forest over the block's components, which joins those that have
    a pair of classes whose likelihood puts them at CUT or above."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for t in stream_groups(batches, ("key", "i", "j")):
            side = t.column("side").to_numpy() == 1
            if not side.any() or side.all():
                continue
            n, regs, comp = t.column("n").to_numpy(), _matrix(t.column("regs")), t.column("comp").to_numpy()
            label = np.unique(comp, return_inverse=True)[1]
            other = np.flatnonzero(~side)

            def near(s, n=n, regs=regs, label=label, other=other):
                fit = other[(label[other] != label[s]) & (np.minimum(n[other], n[s]) * 100 >= np.maximum(n[other], n[s]) * PERCENT)]
                above, below = (regs[s] > regs[fit]).sum(1), (regs[s] < regs[fit]).sum(1)
                return fit[likelihood_slope(above, below, np.float64(n[s]), n[fit].astype(float), CUT) >= 0]

            found = [(comp[s], comp[o]) for s, o in _forest(label, np.flatnonzero(side), near)]
            if found:
                own = t.schema.field("comp").type
                yield pa.RecordBatch.from_arrays([pa.array(c, own) for c in zip(*found, strict=True)], names=["a", "b"])

    return rows.mapInArrow(tidy(run), f"a {kind}, b {kind}")


def common_sizes(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of the sorted sets of ``a`` and ``b``: elements that
    many sets hold by a matrix product, the others by counting their pairs."""
    sides = []
    for sets in (a, b):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((np.concatenate(sets), owner))
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out.astype(np.int64)
    entries, times = [], []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        keep = both[at] == values
        order = np.argsort(at[keep], kind="stable")
        entries.append((at[keep][order], owner[keep][order]))
        times.append(np.bincount(at[keep], minlength=len(both)))
    dense = times[0] * times[1] * 64 >= len(a) * len(b)
    rank = np.cumsum(dense) - 1
    for lo in range(0, int(dense.sum()), 1024):
        parts = []
        for (at, owner), sets in zip(entries, (a, b), strict=True):
            pick = dense[at] & (rank[at] >= lo) & (rank[at] < lo + 1024)
            x = np.zeros((len(sets), 1024), np.float32)
            x[owner[pick], rank[at[pick]] - lo] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    out = out.astype(np.int64).ravel()
    (at, owner), (at2, owner2) = entries
    begin = np.concatenate([[0], np.cumsum(times[1])])
    at, owner = at[~dense[at]], owner[~dense[at]]
    total = np.cumsum(times[1][at])
    lo = 0
    while lo < len(at):  # some four million pairs at a time
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 22), "right")))
        n = times[1][at[lo:hi]]
        second = np.repeat(begin[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(owner[lo:hi], n) * len(b) + owner2[second], minlength=len(out))
        lo = hi
    return out.reshape(len(a), len(b))


def _verified_forest(rows: DataFrame) -> DataFrame:
    """Rows (key, i, j, side, id, comp, s), sorted by (key, i, j): links (a, b)
    of a forest over the block's components, which joins those that have a pair
    of full sets reaching the threshold."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for t in stream_groups(batches, ("key", "i", "j")):
            side = t.column("side").to_numpy() == 1
            if not side.any() or side.all():
                continue
            ids, lists = t.column("id").to_numpy(), t.column("s").combine_chunks()
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            size = np.diff(bounds)
            one, other = np.flatnonzero(side), np.flatnonzero(~side)
            common = common_sizes(*([flat[bounds[x] : bounds[x + 1]] for x in part] for part in (one, other)))
            good = common * 100 >= (size[one][:, None] + size[other][None, :] - common) * PERCENT
            place = dict(zip(one.tolist(), range(len(one)), strict=True))
            label = np.unique(t.column("comp").to_numpy(), return_inverse=True)[1]

            def near(s, good=good, place=place, label=label, other=other):
                return other[good[place[int(s)]] & (label[other] != label[s])]

            found = [(ids[s], ids[o]) for s, o in _forest(label, one, near)]
            if found:
                own = t.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(c, own) for c in zip(*found, strict=True)], names=["a", "b"])

    return rows.mapInArrow(tidy(run), f"a {kind}, b {kind}")


def full_sets(ids: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(id, s: sorted shingle hashes) of the given ids, made from the texts
    (id, text). A bit filter of the ids drops most texts before the shuffle."""
    kind = texts.schema["id"].dataType.simpleString()
    bits = filter_bits(ids.select(F.xxhash64("id").alias("h")))

    def run(batches):
        for x in batches:
            x = x.filter(pa.array(passes(bits, x.column(2).to_numpy().view(np.uint64))))
            if not x.num_rows:
                continue
            sets = []
            for lo, hi, raw, offs in text_blocks(x.column(1)):
                buf = LOWER[raw]
                starts, ends, rows = words(buf, offs, VISIBLE)
                h = word_hashes(buf, starts, ends)
                sets += [shingles(h[rows[r] : rows[r + 1]], k).view(np.int64) for r in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    sets = texts.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(tidy(run), f"id {kind}, s array<bigint>")
    return stored(sets.join(ids, "id", "left_semi"), "setsketch-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.filter(F.col("common") * 100 >= (F.col("total") - F.col("common")) * PERCENT).select("a", "b")


def _with_root(df: DataFrame, comps: DataFrame, column: str, root: str) -> DataFrame:
    """``df`` with the component of ``column`` (itself, if it has no link)."""
    c = comps.select(F.col("node").alias(column), F.col("root").alias(root))
    return df.join(c, column, "left").withColumn(root, F.coalesce(root, column))


def _cells(left: DataFrame, cols: list[str]) -> DataFrame:
    """``left`` (with comp, big, nb) in the blocks (i, j) of its group: each row as
    one of all (side 0) in the blocks of its column, and outside the largest
    component as one to be compared (side 1) in those of its row. The rows are
    made in one pass: a union would run all that leads to ``left`` twice."""
    own = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    every = F.sequence(F.lit(0), F.col("nb") - 1)

    def cell(side: int, i, j):
        return F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))

    alls = F.transform(every, lambda e: cell(0, e, own))
    ones = F.transform(every, lambda e: cell(1, own, e))
    return left.select(*cols, F.inline(F.when(F.col("comp") != F.col("big"), F.concat(alls, ones)).otherwise(alls)))


def _blocks(count, size: int):
    return F.ceil(count / size).cast("int")


def _remaining(rows: DataFrame, comps: DataFrame, sketch: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Steps 4 and 5: links between components that share a bucket."""
    own = stored(_with_root(rows.select("key", "id", "size"), comps, "id", "comp"), "setsketch-own")
    parts = own.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    left = own.join(mixed, "key").join(sketch, "id").withColumn("nb", _blocks(F.col("size"), BLOCK))
    grid = _cells(left, ["key", "id", "comp", "n", "regs"]).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    groups = components(_likely_forest(grid), "setsketch-groups").select(F.col("node").alias("comp"), F.col("root").alias("key"))

    # the classes of the components that may be one, each once
    members = groups.join(comps, F.col("comp") == F.col("root"), "left").select("key", "comp", F.coalesce("node", "comp").alias("id")).distinct()
    members = stored(members.join(sketch.select("id", "n"), "id"), "setsketch-members")
    big = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy("key")
    blocks = F.greatest(_blocks(F.sum("c"), BLOCK // 2), _blocks(F.sum("n") * 8, SET_BYTES))
    left = members.join(big.agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), blocks.alias("nb")), "key")
    sets = full_sets(members.select("id"), texts, k)
    grid = _cells(left, ["key", "id", "comp"]).join(sets, "id").select("key", "i", "j", "side", "id", "comp", "s")
    return _verified_forest(grid.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))


def near_duplicates(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id (smallest id reachable) and kept."""
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    base = stored(_documents(texts, k), "setsketch-docs")
    sig = ["n", "s1", "s2"]
    sets = base.filter("n > 0 and id is not null")
    # one class for each set; the copies of a hot one meet in the map-side part
    classes = stored(sets.groupBy(*sig).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("regs").alias("regs")), "setsketch-classes")
    banded = classes.select("id", F.explode("keys").alias("key"))
    order = F.xxhash64("id", "key")
    buckets = stored(banded.groupBy("key").agg(F.count("*").alias("size"), F.min_by("id", order).alias("hub")).filter("size > 1"), "setsketch-buckets")
    rows = stored(banded.join(buckets, "key"), "setsketch-rows")

    sketch = classes.select("id", F.col("n"), "regs")
    stars = rows.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stars.join(sketch.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
    stars = stars.join(sketch.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
    stars = stars.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    likely = stored(_estimated(stars).filter(F.col("est") >= CUT - 0.02), "setsketch-likely")
    sets = full_sets(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct(), texts, k)
    links = comps = None
    for _ in range(HUB_ROUNDS):
        pairs = likely
        if comps is not None:
            pairs = _with_root(_with_root(likely, comps, "a", "ca"), comps, "b", "cb").filter("ca <> cb")
        best = stored(pairs.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b")), "setsketch-best")
        found = stored(verified(best, sets), "setsketch-links")
        links = found if links is None else links.union(found)
        comps = components(links, "setsketch-components")
        likely = likely.join(best, ["a", "b"], "left_anti")

    second = _remaining(rows, comps, sketch, texts, k)
    # links between components found so far join them
    second = _with_root(_with_root(second, comps, "a", "ca"), comps, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = comps.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = components(roots.union(second), "setsketch-final")

    # classes whose documents are not all their own component; salted, as a
    # class can hold a third of all documents
    moved = _with_root(classes.select(*sig, "id", "copies"), final, "id", "component_id").filter((F.col("copies") > 1) | (F.col("component_id") < F.col("id")))
    moved = moved.select(*sig, "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = base.select("id", *sig, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(moved, [*sig, "salt"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id, unchanged.
    Rows that share a kept id stay, once for each text."""
    gone = near_duplicates(docs, k, doc_id, text).filter("not kept").select(F.col("doc_id").alias("_d")).distinct()
    rest = docs.join(gone, docs[doc_id] == gone["_d"], "left_anti")
    if docs.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).count().filter(F.col("count") > 1).isEmpty():
        return rest  # no id repeats, so there is nothing to compare texts for
    known = rest.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, text])
    return known.union(rest.filter(F.col(doc_id).isNull()))


# All pairs of different sets by the shingles that they share: for the given small
# tables, since it grows with the square of a shingle's documents.
ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) END AS s FROM worded),
classes AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
held AS MATERIALIZED (SELECT id, n, unnest(s) AS shingle FROM classes),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.id <> b.id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT id, id AS other FROM classes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN roots r ON r.id = c.id
"""


def op5(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, by 2-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
