"""Operator 9: language ID.

Averaged hashed subword embeddings with a linear softmax. A text's subwords
are the byte 2-, 3- and 4-grams of its words with their borders (ASCII
lower-cased); each falls in one of ``BUCKETS`` buckets per length with an
embedding of ``DIM`` numbers. The mean of the embeddings goes through a
linear softmax; both are trained by stochastic gradient descent in numpy on
a bounded sample of labelled texts (``sample_rows``, ``sample_bytes``). One more class learns
from junk made of the sample: shuffled characters, random letters, random
characters of any script (``_junk``). A part of both is held back to fit the
temperature and the confidence below which a text is rejected: that which all
but a set share of the rightly labelled texts reach.

As the model is linear after the mean, a task sums one row of
``embedding @ weights`` per subword: whole texts, no per-word Python.

Defined cases: null text or text without a letter gives ``und`` with score
0 and ``rejected``; every input row gives one output row, repeated rows
too; without any labelled text every text is ``und``; other columns of the
input are not looked at. Equal scores go to the language first in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, crc_mod, hash_sample, release, row_sums, text_blocks, tidy, within_bytes

SIZES = (2, 3, 4)
BUCKETS = 1 << 12
DIM = 16
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 64 << 20  # of texts; a sample ends before the text that exceeds them
JUNK_CHARS = 2000  # of a made text
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def _subwords(buf: np.ndarray, offs: np.ndarray):
    """For each n-gram length its bucket and whether it counts, by first byte."""
    b = LOWER[buf]
    letter = _LETTER[b]
    b = np.where(letter, b, np.uint8(32)).astype(np.uint32)
    n = len(b)
    row_end = np.repeat(offs[1:], np.diff(offs))
    for k, size in enumerate(SIZES):
        m = n - size + 1
        if m <= 0:
            continue
        h = np.full(m, size * 0x2545F491 & 0xFFFFFFFF, dtype=np.uint32)
        for j in range(size):
            h = (h ^ b[j : j + m]) * _MULT[j]
        ok = np.arange(m) + size <= row_end[:m]
        ok &= letter[:m] | letter[1 : m + 1]
        for j in range(1, size - 1):
            ok &= letter[j : j + m]
        yield (h >> np.uint32(20)).astype(np.int64) + k * BUCKETS, ok, m


class _Shares:
    """Share of each bucket among a text's subwords: buckets and shares by
    text, made dense only for the rows that are asked for."""

    def __init__(self, texts: list[str]):
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            total = np.zeros(BUCKETS * len(SIZES), np.float32)
            for _, _, buf, offs in text_blocks(pa.array([text], pa.string())):
                for idx, ok, _ in _subwords(buf, offs):
                    total += np.bincount(idx[ok], minlength=len(total))
            used = np.flatnonzero(total).astype(np.int32)
            self.rows.append((used, total[used] / max(total.sum(), np.float32(1))))

    def dense(self, pick: np.ndarray) -> np.ndarray:
        out = np.zeros((len(pick), BUCKETS * len(SIZES)), np.float32)
        for r, i in enumerate(pick):
            used, share = self.rows[i]
            out[r, used] = share
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _junk(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Texts in no language, from every second text in turn."""
    out = []
    for i, t in enumerate(texts[::2]):
        c = np.frombuffer(t[:JUNK_CHARS].encode("utf-32-le", "replace"), np.uint32).copy()
        space = c == 32
        if i % 3 == 0:
            rng.shuffle(c)
        elif i % 3 == 1:
            c = np.where(space, 32, rng.integers(97, 123, len(c))).astype(np.uint32)
        else:
            low = int(rng.integers(0x100, 0x9F00))  # a script's worth of characters
            c = np.where(space, 32, rng.integers(low, low + 64, len(c))).astype(np.uint32)
        out.append(c.tobytes().decode("utf-32-le", "replace"))
    return out


def train(texts: list[str], langs: list[str], epochs: int = 12, rate: float = 0.5, coverage: float = 0.995, seed: int = 7) -> dict:
    """Model from labelled texts; deterministic. ``coverage``: share of the
    rightly labelled held-back texts that the rejection must accept."""
    names = sorted(set(langs))
    if not names:
        return {"langs": [], "table": np.zeros((BUCKETS * len(SIZES), 0), np.float32), "bias": np.zeros(0), "temperature": 1.0, "floor": 0.0}
    rng = np.random.default_rng(seed)
    junk = _junk(texts, rng)
    x = _Shares(texts + junk)
    y = np.array([names.index(v) for v in langs] + [len(names)] * len(junk))
    back = np.concatenate([np.arange(n) % 5 == 4 for n in (len(texts), len(junk))])
    if len(texts) < 20:
        back[:] = False
    learn = np.flatnonzero(~back)
    onehot = np.eye(len(names) + 1, dtype=np.float32)[y[learn]]
    scale = 100.0  # shares are small; the mean embedding is trained at this scale
    emb = rng.normal(0, 0.1, (BUCKETS * len(SIZES), DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(names) + 1)).astype(np.float32)
    bias = np.zeros(len(names) + 1, np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        order = rng.permutation(len(learn))
        for a in range(0, len(order), 32):
            pick = order[a : a + 32]
            xb = x.dense(learn[pick]) * np.float32(scale)
            mean = xb @ emb
            err = (_softmax(mean @ w + bias) - onehot[pick]) / len(pick)
            grad_mean = err @ w.T
            w -= step * (mean.T @ err)
            bias -= step * err.sum(0)
            used = np.flatnonzero(xb.any(0))
            emb[used] -= step / np.float32(scale) * (xb[:, used].T @ grad_mean)
    seen = np.zeros(len(emb), bool)
    for i in learn:
        seen[x.rows[i][0]] = True
    emb[~seen] = 0
    table = (emb @ w * np.float32(scale)).astype(np.float32)
    temperature, floor = 1.0, 0.0
    if back.any():
        held = np.flatnonzero(back)
        z = np.concatenate([x.dense(held[a : a + 256]) @ table for a in range(0, len(held), 256)]) + bias
        truth = y[back]
        grid = np.geomspace(0.25, 8, 25)
        loss = [-np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / temperature)[:, :-1]
        right = p.max(1)[p.argmax(1) == truth]
        if len(right):
            floor = float(np.quantile(right, 1 - coverage))
    return {"langs": names, "table": table, "bias": bias.astype(np.float64), "temperature": temperature, "floor": floor}


def fit(docs: DataFrame, train_filter, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Train on at most ``sample_rows`` labelled texts of at most
    ``sample_bytes`` in all that ``train_filter`` lets in, taken by the id's
    hash. Ids are picked first; only their texts come to the driver."""
    size = F.octet_length(text).alias("_size")
    ids = hash_sample(docs.filter(train_filter & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), size), "_id", sample_rows)
    ids = within_bytes(ids, sample_bytes).distinct()
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t"), F.col(lang).alias("l"))
        .join(F.broadcast(ids), "_id")  # at most sample_rows ids
        .filter(F.col("t").isNotNull() & F.col("l").isNotNull())
        .orderBy(F.xxhash64("_id", F.lit(17)), "_id", "l", F.xxhash64("t"))
        .limit(sample_rows)
        .collect()
    )
    model = train([r["t"] for r in rows], [r["l"] for r in rows])
    release()
    return model


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def score_texts(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language (-1: ``und``) and its probability, per text."""
    langs, table = len(model["langs"]), model["table"]
    best, score = np.full(len(column), -1, np.int64), np.zeros(len(column))
    if not langs:
        return best, score
    cols = [np.ascontiguousarray(c) for c in table.T]  # the languages, and junk
    for lo, hi, buf, offs in text_blocks(column):
        sums, n = np.zeros((hi - lo, len(cols))), np.zeros(hi - lo)
        for idx, ok, m in _subwords(buf, offs):
            ends = np.minimum(offs, m)
            n += row_sums(ok, ends)
            for j in range(len(cols)):
                sums[:, j] += row_sums(np.where(ok, cols[j][idx], np.float32(0)), ends)
        p = _softmax((sums / np.maximum(n, 1)[:, None] + model["bias"]) / model["temperature"])[:, :langs]
        ascii_letter = np.zeros(len(buf), bool)
        lower = LOWER[buf]
        np.logical_and(lower >= 97, lower <= 122, out=ascii_letter)
        has = row_sums(ascii_letter, offs) > 0
        for i in np.flatnonzero(~has):
            has[i] = _has_letter(buf[offs[i] : offs[i + 1]].tobytes())
        best[lo:hi] = np.where(has, p.argmax(1), -1)
        score[lo:hi] = np.where(has, p.max(1), 0.0)
    return best, score


def predict(docs: DataFrame, model: dict, keys: list, text: str = "text") -> DataFrame:
    """``keys`` (columns) plus lang_pred, score and rejected, a row per input row."""
    names = np.array([*model["langs"], UNKNOWN], dtype=object)
    src = docs.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        for b in batches:
            best, score = score_texts(model, b.column(b.num_columns - 1))
            out = [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array((best < 0) | (score < model["floor"]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=schema.names)

    return src.mapInArrow(tidy(run), schema)


def keep(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, unchanged."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            best, score = score_texts(model, b.column(at))
            yield b.filter(pa.array((best >= 0) & (score >= model["floor"])))

    return docs.mapInArrow(tidy(run), docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned where crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_mod("doc_id", 3) == 1
    model = fit(docs, ~held)
    return predict(docs, model, ["doc_id", F.coalesce(held, F.lit(False)).alias("held_out")])
