"""Operator 1: benchmark decontamination by winnowing.

Both sides keep, of every window of ``W`` consecutive ``K``-grams of words,
the one with the smallest hash (the last among equals). ``K + W - 1`` is the
window length, so any shared run of that many words has a kept k-gram in
common, at the same place of the run. Kept k-grams carry up to ``W - 1``
words of context on either side. Fingerprints are joined, each hit is
extended over the two contexts word by word, and runs of at least a whole
window count; as every window holds a kept k-gram, the runs together cover
all of them. An item shorter than a window is one fingerprint of its own
length, looked up at every place.

Scale: documents are read once; a bit filter of the benchmark's hashes, of
at most ``common.FILTER_BITS`` bits whatever the benchmark's size, drops most
fingerprints in the task, and a filter that passes too much costs time, not
rows. The rest is joined by shuffle, salted on the document side, with
benchmark contexts grouped first, so a passage that many documents or items
share is one row there.

Defined cases: null text has no words; every input row gives one output row
(rows alike in id and text share their hits); item ids repeated in the
benchmark count once; an empty benchmark hits nothing; other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, filter_bits, gram_hashes, passes, stored, text_blocks, tidy, word_hashes, words

WINDOW = 10
K = 5
W = WINDOW - K + 1
SALTS = 8

_HIT = "array<struct<fp:bigint,kind:int,pos:int,lo:int,ctx:array<string>>>"
_HIT_ARROW = pa.list_(pa.struct([("fp", pa.int64()), ("kind", pa.int32()), ("pos", pa.int32()), ("lo", pa.int32()), ("ctx", pa.list_(pa.string()))]))


def _kept(h: np.ndarray, row: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the kept k-grams; no window crosses two rows."""
    m = len(h) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
    best, where = grams[at], at.copy()
    for j in range(1, W):
        g = grams[at + j]
        less = g <= best
        best = np.where(less, g, best)
        where[less] = at[less] + j
    mark = np.zeros(len(h), bool)
    mark[where] = True
    return np.flatnonzero(mark)


def _fingerprints(src: DataFrame, lengths: list[int], bits: np.ndarray | None, short_items: bool) -> DataFrame:
    """``src`` (last column: the text) with n_words and hits instead of the
    text. ``bits``: only hashes that this filter lets through. ``lengths``:
    all k-grams of these lengths too. ``short_items``: a text shorter than a
    window is one k-gram of its length."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        for b in batches:
            column = b.column(b.num_columns - 1)
            count, hits = np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
            for lo, hi, raw, offs in text_blocks(column):
                buf = LOWER[raw]
                starts, ends, rows = words(buf, offs, ALNUM)
                count[lo:hi] = np.diff(rows)
                h = word_hashes(buf, starts, ends)
                row = np.repeat(np.arange(hi - lo), np.diff(rows))
                grams = gram_hashes(h, K)
                kept = _kept(h, row, grams)
                found = [(0, K, kept, grams)]
                for n in lengths:
                    g = gram_hashes(h, n)
                    found.append((n, n, np.flatnonzero(row[: len(g)] == row[n - 1 :]) if len(g) else kept[:0], g))
                if short_items:
                    for n in range(1, WINDOW):
                        first = rows[:-1][np.diff(rows) == n]
                        if len(first):
                            found.append((n, n, first, gram_hashes(h, n)))
                for kind, k, at, g in found:
                    at = at if bits is None else at[passes(bits, g[at])]
                    for p in at.tolist():
                        r = int(row[p])
                        a, z = (max(p - W + 1, int(rows[r])), min(p + k + W - 1, int(rows[r + 1]))) if kind == 0 else (p, p + k)
                        ctx = [buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in range(a, z)]
                        hits[lo + r].append({"fp": int(g[p].view(np.int64)), "kind": kind, "pos": p - int(rows[r]), "lo": p - a, "ctx": ctx})
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(count), pa.array(hits, _HIT_ARROW)], names=[*b.schema.names[:-1], "n_words", "hits"])

    return src.mapInArrow(tidy(run), f"{fields}, n_words bigint, hits {_HIT}")


def _lead(a: Column, b: Column) -> Column:
    """Number of equal leading words of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def index_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Benchmark fingerprints: fp, kind, ilo, ictx and the items with them."""
    src = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("_text")).filter("item is not null")
    rows = _fingerprints(src, [], None, True).select("item", F.explode("hits").alias("x"))
    rows = rows.select("item", "x.fp", "x.kind", F.col("x.lo").alias("ilo"), F.col("x.ctx").alias("ictx"))
    return rows.groupBy("fp", "kind", "ilo", "ictx").agg(F.collect_set("item").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, _t: hash of the text, n_words), and of those
    with hits: doc_id, _t, n_hit, items (sorted as strings)."""
    items = stored(index_items(benchmark), "winnow-items")
    bits = filter_bits(items.select("fp"))
    lengths = sorted(r["kind"] for r in items.filter("kind > 0").select("kind").distinct().collect())  # 1 to WINDOW - 1
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_t"), F.col(text).alias("_text"))
    base = stored(_fingerprints(src, lengths, bits, False), "winnow-docs")
    hits = base.filter(F.size("hits") > 0).select("doc_id", "_t", F.explode("hits").alias("x")).select("doc_id", "_t", "x.*")
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "_t", "pos"), F.lit(SALTS)).cast("int"))
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = hits.join(salted, ["fp", "kind", "salt"])
    k = F.when(F.col("kind") == 0, F.lit(K)).otherwise(F.col("kind"))
    back = _lead(F.reverse(F.slice("ctx", F.lit(1), F.col("lo"))), F.reverse(F.slice("ictx", F.lit(1), F.col("ilo"))))
    on = _lead(F.slice("ctx", F.col("lo") + 1, F.size("ctx")), F.slice("ictx", F.col("ilo") + 1, F.size("ictx")))
    both = both.withColumn("back", back).withColumn("on", on)
    whole = F.when(F.col("kind") == 0, (F.col("on") >= k) & (F.col("back") + F.col("on") >= WINDOW)).otherwise(F.col("on") == k)
    runs = both.filter(whole).select("doc_id", "_t", F.struct((F.col("pos") - F.col("back")).alias("s"), (F.col("pos") + F.col("on")).alias("e")).alias("run"), "items")
    per = runs.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set("run")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("e")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["e"]))).alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
        lambda a: a["n"],
    )
    return base.drop("hits"), per.select("doc_id", "_t", covered.alias("n_hit"), "items", "runs")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, runs (word
    spans that benchmark windows cover) and contaminated."""
    base, hit = scan(docs, benchmark, doc_id, text)
    hit = hit.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"), "n_hit", "items", "runs")
    rows = base.join(hit, base["doc_id"].eqNullSafe(hit["_d"]) & (base["_t"] == hit["_u"]), "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("bigint").alias("n_items"),
        "items",
        "runs",
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def keep(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark window, unchanged."""
    _, hit = scan(docs, benchmark, doc_id, text)
    hit = hit.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"))
    return docs.join(hit, docs[doc_id].eqNullSafe(hit["_d"]) & (F.xxhash64(docs[text]) == hit["_u"]), "left_anti")


def op1(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = decontaminate(docs, benchmark)
    joined = F.coalesce(F.concat_ws(",", "items"), F.lit(""))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
