"""Operator 3: toxicity by a linear-chain conditional random field.

Tokens are words; two states, plain and toxic. A token's emission is a sum
of hashed weights of its word, of prefixes of it and of its last three
bytes; transitions are free. Training tokens are labelled from the labelled
documents: a feature held by a fair share of the toxic sample documents and
by far fewer clean ones marks its tokens toxic there; the field is then
fitted by stochastic gradient (AdaGrad) on the likelihood of these tags in
numpy, on a bounded sample (``sample_rows`` documents of each label).

Scoring runs forward and backward over each whole text. With two states
both recursions are one log-odds number a token, so a task steps through
all texts of a batch side by side. The marginals give toxic spans (offsets
in characters); the document score is a logistic function, fitted on the
sample, of the largest marginal and the expected number of toxic tokens.

Defined cases: null text is empty; a text without words has the score of
no evidence; every input row gives one output row; a document labelled more
than once counts as toxic if any label says so; with no toxic label in the
sample all scores are 0; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, crc_mod, hash_sample, release, span_hashes, text_blocks, tidy, words

BUCKETS = 1 << 18
SAMPLE_ROWS = 1500
PREFIXES = (4, 5, 6, 8)
KINDS = len(PREFIXES) + 2
WINDOW = 64
GROUP_BYTES = 16 << 20
_CLIP = 40.0


def token_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(KINDS, tokens) rows of the weight table: word, prefixes, suffix."""
    spans = [(starts, ends), *((starts, np.minimum(starts + k, ends)) for k in PREFIXES), (np.maximum(ends - 3, starts), ends)]
    return np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) + k * BUCKETS for k, h in enumerate(span_hashes(buf, spans))])


def _step(x, a, b, c):
    """log((e^a + e^(x+b)) / (1 + e^(x+c)))"""
    e = np.exp(np.clip(x, -_CLIP, _CLIP))
    return np.log((np.exp(a) + e * np.exp(b)) / (1 + e * np.exp(c)))


def _windows(u: np.ndarray, par: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of (windows, length) emissions."""
    start, t01, t10, t11 = par
    f, b = np.empty_like(u), np.zeros_like(u)
    f[:, 0] = start + u[:, 0]
    for i in range(1, u.shape[1]):
        f[:, i] = u[:, i] + _step(f[:, i - 1], t01, t11, t10)
    for i in range(u.shape[1] - 2, -1, -1):
        b[:, i] = _step(u[:, i + 1] + b[:, i + 1], t10, t11, t01)
    return f, b


def marginal_log_odds(u: np.ndarray, bounds: np.ndarray, par: np.ndarray) -> np.ndarray:
    """Log odds of the toxic state of each token; ``bounds`` closes the rows."""
    start, t01, t10, t11 = par
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    first, length = bounds[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # rows longer than t
    f = np.empty(len(u))
    x = np.zeros(0)
    for t in range(steps):
        at = first[: active[t]] + t
        x = u[at] + (start if t == 0 else _step(x[: active[t]], t01, t11, t10))
        f[at] = x
    out = f.copy()
    back = np.zeros(len(first))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        at = first[:n] + t
        b = _step(u[at + 1] + back[:n], t10, t11, t01)
        back[:n] = b
        out[at] += b
    return out


def _tags(feats: list[np.ndarray], toxic: np.ndarray, min_share: float, min_docs: int, purity: float) -> list[np.ndarray]:
    """Tokens of the sample with a feature that its documents' labels mark."""
    n_tox, n_clean = np.zeros(KINDS * BUCKETS), np.zeros(KINDS * BUCKETS)
    for x, y in zip(feats, toxic, strict=True):
        (n_tox if y else n_clean)[np.unique(x)] += 1
    share_t, share_c = n_tox / max(1, toxic.sum()), n_clean / max(1, (~toxic).sum())
    mark = (n_tox >= min_docs) & (share_t >= min_share) & (share_t >= purity * (share_t + share_c))
    mark[(KINDS - 1) * BUCKETS :] = False  # endings alone don't mark a token
    return [mark[x].any(0) for x in feats]


def train(texts: list[str], toxic: list[int], clean_weight: float = 1.0, epochs: int = 6, rate: float = 0.3, min_share: float = 0.01, min_docs: int = 4, purity: float = 0.9, seed: int = 5) -> dict:
    """Field and document function from labelled documents; deterministic.
    ``clean_weight``: how many times as many clean documents as toxic ones a
    sampled one stands for."""
    w = np.zeros(KINDS * BUCKETS)
    model = {"w": w.astype(np.float32), "bias": -12.0, "par": np.array([0.0, -4.0, 0.0, 0.0]), "doc": None}
    y = np.array(toxic, dtype=bool)
    feats, sizes = [], []
    for _, _, buf, offs in text_blocks(pa.array(texts, pa.string())):
        buf = LOWER[buf]
        starts, ends, rows = words(buf, offs, ALNUM)
        x = token_features(buf, starts, ends)
        feats += [x[:, a:z] for a, z in zip(rows[:-1], rows[1:], strict=True)]
        sizes += np.diff(rows).tolist()
    if not y.any() or y.all():
        return model
    tags = _tags(feats, y, min_share, min_docs, purity)
    if not any(t.any() for t in tags):
        return model
    rng = np.random.default_rng(seed)
    xs, ts = [], []
    for x, t, is_toxic in zip(feats, tags, y, strict=True):
        n = x.shape[1]
        for a in range(0, n, WINDOW):
            piece = t[a : a + WINDOW]
            if piece.any() or rng.random() < (0.2 if not is_toxic else 0.05):
                pad = WINDOW - len(piece)
                xs.append(np.pad(x[:, a : a + WINDOW], ((0, 0), (0, pad)), constant_values=-1))
                ts.append(np.pad(piece & is_toxic, (0, pad)))
    x, t = np.stack(xs), np.stack(ts).astype(float)
    bias, par = -4.0, np.array([0.0, -2.0, 0.0, 1.0])
    g_w, g_bias, g_par = np.full(KINDS * BUCKETS, 1e-6), 1e-6, np.full(4, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), 128):
            xb, tb = x[order[a : a + 128]], t[order[a : a + 128]]
            real = xb[:, 0] >= 0
            on = (rng.random(xb.shape) > 0.3) & (rng.random(real.shape) > 0.05)[:, None] & real[:, None]
            u = bias + (w[xb] * on).sum(1)
            u[~real] = -_CLIP
            f, b = _windows(u, par)
            p = 1 / (1 + np.exp(-np.clip(f + b, -_CLIP, _CLIP)))
            err = (p - tb) * real
            v = u[:, 1:] + b[:, 1:]
            terms = np.stack([np.zeros_like(v), par[1] + v, f[:, :-1] + par[2], f[:, :-1] + par[3] + v])
            pair = np.exp(terms - terms.max(0))
            pair /= pair.sum(0)
            both = real[:, 1:] & real[:, :-1]
            obs = [((1 - tb[:, :-1]) * tb[:, 1:])[both].sum(), (tb[:, :-1] * (1 - tb[:, 1:]))[both].sum(), (tb[:, :-1] * tb[:, 1:])[both].sum()]
            grad_par = np.array([err[:, 0].sum(), *(pair[k][both].sum() - obs[k - 1] for k in (1, 2, 3))])
            idx, weight = xb[on], np.broadcast_to(err[:, None], xb.shape)[on]
            grad = np.bincount(idx, weight, minlength=KINDS * BUCKETS)
            used = np.flatnonzero(grad)
            g = grad[used] + 1e-3 * w[used]
            g_w[used] += g * g
            w[used] -= rate * g / np.sqrt(g_w[used])
            g_bias += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(g_bias)
            g_par += grad_par**2
            par -= rate * grad_par / np.sqrt(g_par)
    model |= {"w": w.astype(np.float32), "bias": float(bias), "par": par}
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    u = np.concatenate([bias + w[f].sum(0) for f in feats]) if bounds[-1] else np.zeros(0)
    ev = _evidence(marginal_log_odds(u, bounds, par), bounds)
    model["doc"] = _logistic(ev, y, np.where(y, 1.0, clean_weight))
    return model


def _evidence(odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row: largest marginal log odds (clipped), log of 1 + the expected
    number of toxic tokens among those with a fair chance, and their share."""
    n = len(bounds) - 1
    out = np.zeros((n, 3))
    out[:, 0] = -12.0
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full, 0] = np.clip(np.maximum.reduceat(odds, bounds[:-1][full]), -12, 12)
        m = np.where(odds > -2, 1 / (1 + np.exp(-np.clip(odds, -_CLIP, _CLIP))), 0)
        out[full, 1] = np.log1p(np.add.reduceat(m, bounds[:-1][full]))
    out[:, 2] = np.log((np.expm1(out[:, 1]) + 0.05) / (np.diff(bounds) + 20))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Newton's method, ridge on the slopes; the last number is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(a.shape[1])
    pen = ridge * np.array([1.0] * x.shape[1] + [0.01])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pen)
        d = np.linalg.solve(h, a.T @ (weight * (y - p)) - pen * c)
        c += np.clip(d, -2, 2)
        if np.abs(d).max() < 1e-9:
            break
    return c


def score_texts(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    """Document score, number of toxic tokens and toxic spans of each text."""
    score, count, spans = np.zeros(len(column)), np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
    if model["doc"] is None:
        return score, count, spans
    for lo, hi, raw, offs in text_blocks(column, GROUP_BYTES):
        u_parts, s_parts, e_parts, bounds = [], [], [], [np.zeros(1, np.int64)]
        a = 0
        while a < hi - lo:  # emissions by the megabyte, recursions over the whole group
            z = max(int(np.searchsorted(offs, offs[a] + (1 << 20), "right")) - 1, a + 1)
            buf = LOWER[raw[offs[a] : offs[z]]]
            starts, ends, rows = words(buf, offs[a : z + 1] - offs[a], ALNUM)
            u = np.full(len(starts), model["bias"])
            for f in token_features(buf, starts, ends):
                u += model["w"][f]
            u_parts.append(u)
            s_parts.append(starts + offs[a])
            e_parts.append(ends + offs[a])
            bounds.append(rows[1:] + bounds[-1][-1])
            a = z
        u, starts, ends, bounds = map(np.concatenate, (u_parts, s_parts, e_parts, bounds))
        odds = marginal_log_odds(u, bounds, model["par"])
        ev = _evidence(odds, bounds)
        c = model["doc"]
        score[lo:hi] = 1 / (1 + np.exp(-np.clip(ev @ c[:-1] + c[-1], -30, 30)))
        hit = np.flatnonzero(odds > 0)
        row = np.searchsorted(bounds, hit, "right") - 1
        np.add.at(count, lo + row, 1)
        prev = (-2, -1)
        chars, of = None, -1  # characters before each byte of a row: a byte 10xxxxxx goes on with one
        for i, r in zip(hit.tolist(), row.tolist(), strict=True):
            p = float(1 / (1 + np.exp(-min(odds[i], _CLIP))))
            if r != of:
                chars, of = np.concatenate([[0], np.cumsum((raw[offs[r] : offs[r + 1]] & 0xC0) != 0x80, dtype=np.int32)]), r
            a, z = (int(chars[x - offs[r]]) for x in (starts[i], ends[i]))
            own = spans[lo + r]
            if prev == (r, i - 1):
                own[-1] = (own[-1][0], z, max(own[-1][2], p))
            else:
                own.append((a, z, p))
            prev = (r, i)
    return score, count, spans


def fit(docs: DataFrame, labels: DataFrame, train_filter, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Train on at most ``sample_rows`` documents of each label, by the id's
    hash, among the labelled ids that ``train_filter`` lets in. Ids are
    picked first; only their texts come to the driver."""
    marks = labels.filter(train_filter & F.col(doc_id).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    present = docs.select(F.col(doc_id).alias("_id")).distinct()
    marks = marks.join(present, "_id", "left_semi")
    marks = marks.withColumn("_toxic", (F.col("_toxic") > 0).cast("int"))
    total = {r["_toxic"]: r["count"] for r in marks.groupBy("_toxic").count().collect()}
    ids = hash_sample(marks.filter("_toxic = 1"), "_id", sample_rows).unionByName(hash_sample(marks.filter("_toxic = 0"), "_id", sample_rows))
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t"))
        .join(F.broadcast(ids), "_id")  # at most 2 * sample_rows ids
        .orderBy(F.xxhash64("_id", F.lit(17)), "_id", F.xxhash64("t"))
        .limit(2 * sample_rows)
        .collect()
    )
    stands_for = {k: max(1.0, n / sample_rows) for k, n in total.items()}
    model = train([r["t"] for r in rows], [r["_toxic"] for r in rows], stands_for.get(0, 1.0) / stands_for.get(1, 1.0))
    release()
    return model


def predict(docs: DataFrame, model: dict, keys: list, text: str = "text") -> DataFrame:
    """``keys`` plus score, predicted, n_toxic_tokens and spans, a row per input row."""
    src = docs.select(*keys, F.col(text).alias("_text"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_toxic_tokens", T.LongType()), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        for b in batches:
            score, count, spans = score_texts(model, b.column(b.num_columns - 1))
            found = pa.array([[{"start": s, "end": e, "p": p} for s, e, p in x] for x in spans], arrow)
            out = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count), found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=schema.names)

    return src.mapInArrow(tidy(run), schema)


def keep(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            score, _, _ = score_texts(model, b.column(at))
            yield b.filter(pa.array(score < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned where crc32(doc_id) mod 5 is not 0."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, crc_mod("doc_id", 5) != 0)
    return predict(docs, model, ["doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")])
