"""Operator 13: near-duplicates by SimHash and a byte-position inverted index.

A document's fingerprint has one bit for each bit of the 64-bit hashes of its
word shingles (repeats count): 1 if it is set in over half of them. Two
fingerprints link if at most ``BITS`` = 2 bits differ. Those bits lie in at
most two of the eight bytes, so linked fingerprints share the bytes of at
least ``MINIMUM`` = 6 positions. Steps:

1. One pass over the texts makes the fingerprints. Equal ones become one
   class, stood for by the smallest id.
2. Inverted index over positional bytes. Of the four pairs of positions (0, 1),
   (2, 3), (4, 5), (6, 7) two at least are shared whole, so a posting list is
   keyed by the four bytes of two such pairs: six lists a class.
3. In a list of at most ``LIST`` classes the shared positional bytes of every
   two classes are tallied; those that reach the minimum are verified by the
   number of differing bits. What leaves the task are the links of a spanning
   forest: fewer than the list has members.
4. A longer list is dealt on to lists of two of its four free positions more
   (six of them; two more positions must be shared). These fix six positions,
   so they hold at most 65,536 classes whatever the table's size. There
   every class looks up the 136 values that one or two bits of the two free
   bytes make, which is linear in the list.
5. The forests' links join into components.

Hot groups: copies collapse before any join, lists are counted before they are
dealt, the long ones split as above, and the join back to the documents is
salted (``SALTS``), as a class can hold a third of them.

Defined cases: documents without words (null, empty, white space) have the
fingerprint zero and link like any other; fewer words than a shingle are one
shingle; rows that share an id are one node, also with different texts; rows
with a null id link with nothing, have a null component and are kept; every
input row gives one output row; an empty table gives none; other columns are
not looked at. Nothing is cut: the longest text is hashed whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .components import components

BITS = 2
MINIMUM = 8 - BITS
LIST = 512
SALTS = 8
SEED = 42


def _mask(positions) -> int:
    """The bytes at ``positions`` (0 is the lowest), as a signed 64-bit mask."""
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


#: positions of the short lists: two of the four pairs of positions
LISTS = [a + b for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]
#: positions of the lists that a long one is dealt on to
DEEP = {t: [tuple(sorted(t + more)) for more in combinations([p for p in range(8) if p not in t], MINIMUM - 4)] for t in LISTS}
#: one or two bits of two bytes
FLIPS = np.array([sum(1 << b for b in c) for n in range(1, BITS + 1) for c in combinations(range(16), n)], np.int64)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each run of ``k`` words (fewer words: of all of them)."""
    w = text.lower().split()  # bytes: A-Z only, white space is 0x20 and 0x09 to 0x0D
    if not w:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(w))
    size = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    k = min(k, len(w))
    spans = zip((ends - size)[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:z], SEED) for a, z in spans), np.uint64, len(w) - k + 1)


def fingerprint(text: bytes, k: int) -> int:
    """The unsigned fingerprint of one text."""
    h = shingle_hashes(text, k)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[a : a + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed number."""
    src = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", k) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(tidy(run), f"id {src.schema[0].dataType.simpleString()}, fp bigint")


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else np.unpackbits(x.view(np.uint8).reshape(*x.shape, 8), axis=-1).sum(-1)


def _settle(label: np.ndarray, neighbours) -> np.ndarray:
    """Smallest index that each index reaches; ``neighbours`` gives every
    index's smallest label among itself and its neighbours."""
    while True:
        new = neighbours(label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tallied(fp: np.ndarray) -> np.ndarray:
    """Component (smallest index) of each fingerprint of a short list: tally
    of the shared positional bytes, minimum, differing bits."""
    x = fp[:, None] ^ fp[None, :]
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(2)
    near = shared >= MINIMUM
    near[near] = _bit_count(x[near]) <= BITS
    n = len(fp)
    return _settle(np.arange(n), lambda label: np.minimum(label, np.where(near, label[None, :], n).min(1)))


def flipped(fp: np.ndarray) -> np.ndarray:
    """The same for a list whose fingerprints, all different, share all but two bytes."""
    free = [p for p in range(8) if ((fp ^ fp[0]) >> np.uint64(8 * p) & np.uint64(0xFF)).any()]
    free = (free + [p for p in range(8) if p not in free])[:2]
    value = np.zeros(len(fp), np.int64)
    for i, p in enumerate(free):
        value |= ((fp >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.int64) << (8 * i)
    at = np.full(1 << 16, len(fp), np.int64)
    at[value] = np.arange(len(fp))

    def neighbours(label):
        known, new = np.append(label, len(fp)), label.copy()
        for f in FLIPS:
            np.minimum(new, known[at[value ^ f]], out=new)
        return new

    return _settle(np.arange(len(fp)), neighbours)


def _forests(postings: DataFrame) -> DataFrame:
    """Rows (list, key, fp, id), sorted by (list, key): links (a, b) of each
    list's forest. A list may span batches; lists of one and two are taken at once."""
    kind = postings.schema["id"].dataType.simpleString()

    def links(key, fp, ids):
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
        two = lo[hi - lo == 2]
        two = two[_bit_count(fp[two] ^ fp[two + 1]) <= BITS]
        a, b = [ids[two]], [ids[two + 1]]
        for x, z in zip(lo[hi - lo > 2].tolist(), hi[hi - lo > 2].tolist(), strict=True):
            root = tallied(fp[x:z]) if z - x <= LIST else flipped(fp[x:z])
            moved = np.flatnonzero(root != np.arange(z - x))
            a.append(ids[x:z][moved])
            b.append(ids[x:z][root[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parts of the last list so far
        for x in batches:
            if not x.num_rows:
                continue
            key = np.stack([x.column("list").to_numpy().astype(np.int64), x.column("key").to_numpy()])
            fp, ids = x.column("fp").to_numpy().view(np.uint64), x.column("id").to_numpy()
            other = np.flatnonzero((key != key[:, -1:]).any(0))
            same = int(other[-1]) + 1 if len(other) else 0  # where the batch's last list begins
            if held and (same or (held[-1][0][:, -1] != key[:, 0]).any()):
                held.append((key[:, :same], fp[:same], ids[:same]))
                yield links(*(np.concatenate(c, axis=-1) for c in zip(*held, strict=True)))
                held = []
            elif same:
                yield links(key[:, :same], fp[:same], ids[:same])
            held.append((key[:, same:], fp[same:], ids[same:]))
        if held:
            yield links(*(np.concatenate(c, axis=-1) for c in zip(*held, strict=True)))

    return postings.mapInArrow(tidy(run), f"a {kind}, b {kind}")


def _postings(rows: DataFrame, lists: list[tuple[int, ...]]) -> Column:
    """The (list, key) entries of column fp: list is its positions as bits."""
    return F.explode(F.array(*[F.struct(F.lit(sum(1 << p for p in t)).alias("list"), rows["fp"].bitwiseAND(F.lit(_mask(t))).alias("key")) for t in lists]))


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes (id, fp: all different): a spanning
    forest of each posting list, which together join what is near."""
    posted = classes.select("id", "fp", _postings(classes, LISTS).alias("p")).select("id", "fp", "p.*")
    sizes = posted.groupBy("list", "key").agg(F.count("*").alias("size")).filter("size > 1")
    posted = stored(posted.join(sizes, ["list", "key"]), "simhash-postings")
    deep = None
    for t, more in DEEP.items():
        long = posted.filter((F.col("list") == sum(1 << p for p in t)) & (F.col("size") > LIST)).select("id", "fp")
        long = long.select("id", "fp", _postings(long, more).alias("p")).select("p.*", "fp", "id")
        deep = long if deep is None else deep.unionByName(long)
    lists = posted.filter(F.col("size") <= LIST).select("list", "key", "fp", "id").unionByName(deep.distinct())
    return _forests(lists.repartition("list", "key").sortWithinPartitions("list", "key"))


def near_duplicates(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: doc_id, fingerprint (16 lowercase hex digits) and
    component_id (smallest id reachable), for shingles of ``k`` words."""
    base = stored(fingerprints(docs, k, doc_id, text), "simhash-docs")
    named = base.filter("id is not null")
    classes = stored(named.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "simhash-classes")
    # rows that share an id but not the fingerprint: the id links their classes
    several = named.groupBy("id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least <> most").select("id")
    same = named.join(several, "id").distinct().join(classes.select("fp", F.col("id").alias("b")), "fp").select(F.col("id").alias("a"), "b")
    # two classes of one smallest id are one node already
    comps = components(links(classes.select("id", "fp")).unionByName(same), "simhash-components")
    moved = classes.join(comps.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("component_id", F.coalesce("root", "id"))
    moved = moved.filter((F.col("copies") > 1) | (F.col("component_id") < F.col("id")))
    moved = moved.select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(moved, ["fp", "salt"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def keep(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but those of ids that another component member
    with a smaller id stands for."""
    gone = near_duplicates(docs, k, doc_id, text).filter("component_id < doc_id").select(F.col("doc_id").alias("_d")).distinct()
    return docs.join(gone, docs[doc_id] == gone["_d"], "left_anti")


def op13(spark, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents, by 3-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3)
