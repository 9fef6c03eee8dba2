"""Operator 12: spelling variants by pivotal bigrams.

Deng et al., "A Pivotal Prefix Based Filtering Algorithm for String Similarity
Search" (2014), for one edit. Bigrams are ordered from rare to frequent. A
word's prefix are its three rarest bigrams (with ties all of them); among these
two that do not overlap always exist, and dynamic programming over the positions
picks the pair with the least occurrences: the pivots. One edit touches one
pivot at most. So of two near words s and r, with the last bigram of s's prefix
not after that of r's, a pivot of s occurs in r's prefix, and

- not shifted, with the same letters up to its end, if the edit comes after it;
- at the same distance from the end, with the same letters from its begin on,
  if the edit comes before it.

The index holds each prefix bigram by the hash of those letters, which fixes the
bigram and its position limit; pivots look it up. Where they are fewer than
``CONTEXT``, as many words have them, the letters to the edit's side are cut
``CONTEXT`` letters from the word's border: the edit comes after the cut, and
the key is all ``CONTEXT`` letters, or before it, and the key has the letters
beyond the cut too. The other word may be shorter or longer by one, so a pivot
looks up three such keys, while the index holds one.

Equal keys are candidates, if the lengths differ by one at most and the prefixes
are in order; the pair is verified by its edit distance, all in the join's
condition, so that only near pairs leave it.

A word's form is its near word of largest count, if that is ``TIMES`` = 10 times
its own at least. Counts grow tenfold along the forms, so a root is reached by
doubling the steps as often as the largest count allows.

Hot groups: occurrences are counted on the map side; a key that many words
share (a frequent begin or end) only meets its pivots in an inner sort-merge
join that adaptive execution splits. A word of n code points has at most
180 n + 90 near words, so groups by word are bounded. The bigrams' counts,
at most 90 * 90, are the only thing that goes to the driver.

Defined cases: a null text has no words, a null id counts as an empty text;
words of fewer than seven code points or one occurrence are none; repeated rows
count again; ties of the largest count go to the first word in code-point
order; an empty table gives no rows; other columns are not looked at. No text
and no word is cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, span_hashes, stored

LEAST = 7
CONTEXT = 6  # below LEAST
TIMES = 10
DELETE = 31
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = r"""
WITH RECURSIVE poly AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS v, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM poly WHERE step < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM poly WHERE step = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda s, x: xor(s // 256, t[xor(s % 256, x) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM counted, crc),
results AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM links GROUP BY a),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.top >= 10 * w.n THEN (SELECT min(l.b) FROM links l WHERE l.a = w.word AND l.n = x.top) END AS form
  FROM words w LEFT JOIN best x ON x.a = w.word),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, g.n AS form_n
FROM formed f JOIN roots r ON r.word = f.word LEFT JOIN words g ON g.word = f.form
"""


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n): words of ``least`` code points or more that occur twice or more."""
    if least <= CONTEXT:
        raise ValueError(f"words need more than {CONTEXT} code points")
    run = F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run)
    runs = runs.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWERED)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETE == 0, less).otherwise(F.col("run")).alias("word")
    return runs.select("run", h.alias("h")).select(word).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a code point (all are below U+0100) and the words' offsets."""
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    lead = raw == 0xC3  # the first byte of U+00C0 to U+00FF; the second is 0x40 less
    flat = np.where(raw >= 0x80, raw + np.uint8(0x40), raw)[~lead]
    return flat, np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy())])


def _bigrams(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the bigram that begins at each letter; whether there is one."""
    code = np.zeros(len(flat), np.int64)
    code[:-1] = flat[:-1].astype(np.int64) * 256 + flat[1:]
    there = np.ones(len(flat), bool)
    there[offs[1:] - 1] = False
    return code, there


def bigram_counts(words: DataFrame) -> np.ndarray:
    """Occurrences of each bigram code in the words."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            if b.num_rows:
                code, there = _bigrams(*letters(b.column(0)))
                total += np.bincount(code[there], minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["code", "n"])

    rows = words.select("word").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most 90 * 90
    out = np.zeros(1 << 16, np.int64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out


def pivots(order: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length, by rows the order and occurrences of their
    bigrams: whether each bigram is in the prefix, the prefix's last order, and
    the positions of the two pivots."""
    last = np.partition(order, 2, axis=1)[:, 2]
    prefix = order <= last[:, None]
    cost = np.where(prefix, cost.astype(float), np.inf)
    # best[j]: least cost up to position j; the later pivot adds to best[j - 2]
    best = np.minimum.accumulate(cost, axis=1)
    second = np.argmin(cost[:, 2:] + best[:, :-2], axis=1) + 2
    first = np.argmin(np.where(np.arange(order.shape[1])[None, :] <= (second - 2)[:, None], cost, np.inf), axis=1)
    return prefix, last, first, second


def _keys(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, shifts: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of the bigrams ``at`` in the words ``begin`` to ``end``, each with
    the bigrams that have it. ``shifts``: by how much the other word may be
    shorter, for a pivot; (0,) for an entry of the index."""
    out = []
    for side, (near, far, way) in enumerate(((begin, end, 1), (end, begin, -1))):
        edge = at + 2 if side == 0 else at  # the letters between near and edge are the same
        length = np.abs(edge - near).astype(np.uint64)
        wide = near + way * np.maximum(CONTEXT, np.abs(edge - near))

        def hashed(x, z, side=side):
            return span_hashes(flat, [(x, z) if side == 0 else (z, x)])[0]

        tag = mix(length * np.uint64(4) + np.uint64(2 * side))
        out.append((mix(hashed(near, wide) ^ tag), np.arange(len(at))))
        short = np.flatnonzero(length < CONTEXT)
        same = hashed(near[short], edge[short])
        for s in shifts:
            rest = hashed(near[short] + way * (CONTEXT + s), far[short])
            out.append((mix((same * np.uint64(0x9E3779B97F4A7C15)) ^ rest ^ ~tag[short]), short))
    return out


def _entries(words: DataFrame, counts: np.ndarray, want_pivots: bool) -> DataFrame:
    """(key, word, n, size, last): the index's entries of each word, or those
    that its pivots look up."""
    order = np.empty(1 << 16, np.int32)
    order[np.lexsort((np.arange(1 << 16), counts))] = np.arange(1 << 16)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat, offs = letters(b.column("word"))
            code, _ = _bigrams(flat, offs)
            size = np.diff(offs)
            row, at, last = [], [], np.zeros(len(size), np.int32)
            for n in np.unique(size):
                same = np.flatnonzero(size == n)
                grams = code[offs[same][:, None] + np.arange(n - 1)[None, :]]
                prefix, last[same], one, two = pivots(order[grams], counts[grams])
                r, p = (np.tile(np.arange(len(same)), 2), np.concatenate([one, two])) if want_pivots else np.nonzero(prefix)
                row.append(same[r])
                at.append(offs[same[r]] + p)
            row, at = np.concatenate(row), np.concatenate(at)
            keys = _keys(flat, offs[row], offs[row + 1], at, (-1, 0, 1) if want_pivots else (0,))
            own = pa.array(np.concatenate([row[i] for _, i in keys]))
            cols = [pa.array(np.concatenate([k for k, _ in keys]).view(np.int64)), b.column("word").take(own), b.column("n").take(own), pa.array(size.astype(np.int32)).take(own), pa.array(last).take(own)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "word", "n", "size", "last"])

    return words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint, size int, last int")


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, na, nb): pairs of words (word, n) that one edit tells apart, either way round."""
    counts = bigram_counts(words)
    s, r = _entries(words, counts, True).alias("s"), _entries(words, counts, False).alias("r")
    limits = (F.col("s.last") <= F.col("r.last")) & F.col("r.size").between(F.col("s.size") - 1, F.col("s.size") + 1) & (F.col("s.word") != F.col("r.word"))
    near = s.join(r, (F.col("s.key") == F.col("r.key")) & limits & (F.levenshtein("s.word", "r.word", 1) == 1))
    pairs = near.select(F.explode(F.array(*[F.struct(F.col(f"{x}.word").alias("a"), F.col(f"{y}.word").alias("b"), F.col(f"{x}.n").alias("na"), F.col(f"{y}.n").alias("nb")) for x, y in ("sr", "rs")])).alias("p"))
    # a pair is found by several keys; one shuffle serves the distinct rows and the groups by a
    return pairs.select("p.*").repartition("a").distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """For each of ``words`` (word, n): form, root, n_near and form_n."""
    words = stored(words, "pivotal-words")
    best = near_words(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), F.col("b").alias("b"))).alias("top"))
    high = -F.col("top.m")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(high >= times * F.col("n"), F.struct(F.col("top.b").alias("form"), high.alias("form_n"))).alias("f"))
    out = stored(out.select("word", "n", "n_near", "f.form", "f.form_n"), "pivotal-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = out.filter("form is not null").select("word", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(max(math.log(most, times), 1)))):  # log(most, times) forms in a row at most
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"pivotal-roots-{i}")
    return out.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
