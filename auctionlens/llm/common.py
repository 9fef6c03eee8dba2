"""Shared helpers: text blocks and word hashing in numpy, checkpointed tables.

Texts reach the tasks as Arrow string columns. A block is a run of whole
rows of about one megabyte, seen as one byte array plus row offsets, so a
task works through texts of any number in bounded memory and never makes a
Python string a word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text (bytes of
#: multi-byte characters are all 0x80 or more)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: words ``[^\x20\x09-\x0D]+``
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[32, 9, 10, 11, 12, 13]] = False

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    t = _tables.get(base)
    if t is None or len(t) < n:
        t = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        _tables[base] = t
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES):
    """``(lo, hi, bytes, offsets)`` of runs of whole rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1, lo + 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and each row's first word index
    (one more entry closes the last row). No word crosses two rows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[buf]
    edge = offs[(offs > 0) & (offs < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, spans) -> list[np.ndarray]:
    """64-bit hashes of the bytes of (starts, ends) spans, one array for each
    pair; alike in every block and task."""
    n = len(buf)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n + 1)[:n], out=total[1:])
    back = _powers(_INV, n + 1)
    return [mix((total[z] - total[a]) * back[a] + (z - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for a, z in spans]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return span_hashes(buf, [(starts, ends)])[0]


def hash_words(items: list[bytes]) -> np.ndarray:
    """``word_hashes`` of given words."""
    if not items:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(b"".join(items), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in items])
    return word_hashes(buf, ends - [len(x) for x in items], ends)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, by its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        g = g * np.uint64(_BASE) + h[j : j + n]
    return mix(g)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``bounds`` (empty rows: 0)."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of an id as text, modulo ``mod`` (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A fixed pseudo-random sample of at most ``rows`` rows, by the key's hash.

    The rows are counted first: those whose hash is beyond a threshold that
    leaves about a fifth more than asked for (and eight standard errors) are
    filtered out before the sort, so tasks send on few rows more than are kept."""
    h = F.xxhash64(F.col(key), F.lit(17))
    share = (1.2 * rows + 8 * rows**0.5 + 64) / max(df.count(), 1)
    if share < 1:
        df = df.filter(h < int((share - 0.5) * 2.0**64))
    return df.orderBy(h, F.col(key)).limit(rows)


def within_bytes(sample: DataFrame, most: int, key: str = "_id", size: str = "_size") -> DataFrame:
    """The keys of a bounded sample, in the order of ``hash_sample``, as long
    as their sizes come to at most ``most`` (the first one in any case)."""
    so_far = Window.orderBy(F.xxhash64(F.col(key), F.lit(17)), F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    total = sample.withColumns({"_total": F.sum(size).over(so_far), "_nth": F.count(F.lit(1)).over(so_far)})
    return total.filter((F.col("_total") <= most) | (F.col("_nth") == 1)).select(key)


FILTER_BITS = 1 << 26


def filter_bits(hashes: DataFrame) -> np.ndarray:
    """Bit filter of a single column of 64-bit hashes, sized by their number
    up to FILTER_BITS (8 MB): a set that outgrows it lets more through."""
    (name,) = hashes.columns
    n = hashes.count()
    size = 1 << 16
    while size < min(32 * n, FILTER_BITS):
        size *= 2
    at = hashes.select(F.col(name).bitwiseAND(F.lit(size - 1)).alias("at"))  # the remainder by a power of two
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(size // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


BATCH_ROWS = 1500


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's rows per Arrow batch to ``rows``: rows that hold
    texts are some kilobytes wide, and a batch exists in the JVM, in the worker
    and as a result at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Gives memory that Arrow and numpy have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """``run`` (for mapInArrow), giving back the memory it has freed when a
    task ends: the worker stays for later tasks, of other steps too."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``;
    a scratch folder only where it is unset and the master is local."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
        d = tempfile.mkdtemp(prefix="llm-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps start
    from the files, not from the lineage, and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stream_groups(batches, keys: tuple[str, ...]):
    """Arrow tables of the consecutive groups of equal integer ``keys`` in a
    sorted partition; a group may span batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        marks = np.stack([t.column(c).to_numpy() for c in keys])
        bounds = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist()]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield t.slice(lo, hi - lo)
        rest = t.slice(bounds[-1])
    if rest is not None and rest.num_rows:
        yield rest
