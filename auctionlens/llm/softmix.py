"""Operator 6: mixing sources to target weights by soft membership.

The domains are the label combinations of the labels table (quality and
toxic). A linear softmax over hashed words, fitted by stochastic gradient
descent in numpy on a bounded sample of labelled documents (``sample_rows``),
gives every document posteriors over the domains. A document of n words thus
holds an expected n * p tokens of each domain; its rate r >= 0 says how often
it is taken. The rates solve the least squares problem

    min |x - T|^2,  x: the sum of n r p over the documents,  T: target tokens,

by projected gradient steps r <- max(0, r - p . s) from r = 1, in variables
scaled by a document's tokens, so that its rate follows its posteriors and not
its length. A step is implicit: its s is (x - T) / m at the rates after it, for
a small m (``DAMPING`` of all tokens), which makes any length of step safe and
leaves a convex problem in the K numbers of s. Newton's method solves that; each
of its rounds is one pass over the posteriors that returns value, totals and
curvature for ``TRIALS`` lengths of its direction. Steps go on until all domains
are within ``TOLERANCE`` of the total, or a step brings the distance down by less
than ``STALL``: then the targets cannot be met, and the rates are those of the
nearest totals that can. A document's rate depends only on its own tokens and
the steps so far, so nothing but K * K numbers a trial goes to the driver and
nothing is kept by document between passes.

Targets are weights of the domains; those of domains that the labels lack are
spread over the rest. A domain of which more than ``most`` times its expected
tokens are asked is not filled with copies of the few documents that it has: it
gets the tokens that it holds, and the weight left over is spread over the rest.
``mixed`` returns the tokens asked, the target followed and the tokens reached by
domain, and ``mix`` warns wherever less or more than asked is reached. The total
is the number of words of all documents.

Defined cases: null or empty texts have no tokens, the posteriors of an empty
bag and rate 1; every input row gives one output row; without labels there is
one domain, and rates are 1; ties of the largest posterior go to the first
domain; an empty table has no rows; other columns are not looked at.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, VISIBLE, hash_sample, release, row_sums, stored, text_blocks, tidy, within_bytes, word_hashes, words

BUCKETS = 1 << 14
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 64 << 20  # of texts; a sample ends before the text that exceeds them
DAMPING = 1e-6
TRIALS = 2.0 ** -np.array([-2, 0, 1, 2, 4, 7, 10])
ROUNDS, STALL = 40, 0.001
TOLERANCE = 1e-4
MOST = 10.0  # target tokens over expected tokens of a domain

#: default weights by (quality, toxic)
TARGETS = {"q1t0": 0.8, "q0t0": 0.12, "q1t1": 0.07, "q0t1": 0.01}


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word buckets of each text, and their counts over the root of the number of words."""
    out = []
    for text in texts:
        total, n = np.zeros(BUCKETS, np.float32), 0
        for _, _, raw, offs in text_blocks(pa.array([text], pa.string())):
            buf = LOWER[raw]
            starts, ends, _ = words(buf, offs, VISIBLE)
            total += np.bincount((word_hashes(buf, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            n += len(starts)
        used = np.flatnonzero(total).astype(np.int32)
        out.append((used, total[used] / np.sqrt(np.float32(max(n, 1)))))
    return out


def _dense(bags: list[tuple[np.ndarray, np.ndarray]], pick: np.ndarray) -> np.ndarray:
    out = np.zeros((len(pick), BUCKETS), np.float32)
    for r, i in enumerate(pick):
        used, value = bags[i]
        out[r, used] = value
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], domains: list[str], epochs: int = 15, rate: float = 1.0, seed: int = 2) -> dict:
    """Linear softmax from labelled texts; deterministic."""
    names = sorted(set(domains)) or ["all"]
    w, bias = np.zeros((BUCKETS, len(names)), np.float32), np.zeros(len(names), np.float32)
    if len(names) > 1:
        rng = np.random.default_rng(seed)
        bags = _bags(texts)
        y = np.eye(len(names), dtype=np.float32)[[names.index(d) for d in domains]]
        bias = np.log(y.mean(0)).astype(np.float32)
        for epoch in range(epochs):
            step = np.float32(rate / (1 + 0.3 * epoch))
            order = rng.permutation(len(y))
            for a in range(0, len(order), 64):
                p = order[a : a + 64]
                x = _dense(bags, p)
                err = (_softmax(x @ w + bias) - y[p]) / len(p)
                w -= step * (x.T @ err + np.float32(1e-4) * w)
                bias -= step * np.float32(0.1) * err.sum(0)
    return {"domains": names, "w": w, "bias": bias.astype(np.float64)}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Train on at most ``sample_rows`` labelled documents of at most
    ``sample_bytes`` in all, by the id's hash."""
    named = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    marks = labels.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), named.alias("_domain")).filter("_domain is not null").groupBy("_id").agg(F.min("_domain").alias("_domain"))
    marks = marks.join(docs.select(F.col(doc_id).alias("_id")).distinct(), "_id", "left_semi")
    ids = hash_sample(marks, "_id", sample_rows)
    sizes = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("_size")).join(F.broadcast(ids.select("_id")), "_id")
    ids = ids.join(sizes.groupBy("_id").agg(F.max("_size").alias("_size")), "_id")
    ids = ids.select("_id", "_domain").join(within_bytes(ids, sample_bytes), "_id")
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t"))
        .join(F.broadcast(ids), "_id")  # at most sample_rows ids
        .orderBy(F.xxhash64("_id", F.lit(17)), "_id", F.xxhash64("t"))
        .limit(sample_rows)
        .collect()
    )
    model = train([r["t"] for r in rows], [r["_domain"] for r in rows])
    release()
    return model


def posteriors(docs: DataFrame, model: dict, keys: list[Column], text: str = "text") -> DataFrame:
    """``keys`` plus n_tokens and p (array, in the order of the model's domains)."""
    src = docs.select(*keys, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    cols = [np.ascontiguousarray(model["w"][:, j]) for j in range(len(model["domains"]))]

    def run(batches):
        for b in batches:
            column = b.column(b.num_columns - 1)
            z, n = np.zeros((len(column), len(cols))), np.zeros(len(column), np.int64)
            for lo, hi, raw, offs in text_blocks(column):
                buf = LOWER[raw]
                starts, ends, rows = words(buf, offs, VISIBLE)
                at = (word_hashes(buf, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
                n[lo:hi] = np.diff(rows)
                for j, c in enumerate(cols):
                    z[lo:hi, j] = row_sums(c[at], rows)
            p = _softmax(z / np.sqrt(np.maximum(n, 1))[:, None] + model["bias"])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(cols)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n), flat], names=[*b.schema.names[:-1], "n_tokens", "p"])

    return src.mapInArrow(tidy(run), f"{fields}, n_tokens bigint, p array<double>")


def _arrays(n, p) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers and (rows, domains) posteriors."""
    return n.to_numpy(), p.flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)


def _rates(n: np.ndarray, p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents after the given steps."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(0.0, r - p @ s)
    return np.where(n > 0, r, 1.0)


def asked(targets: dict[str, float], domains: list[str], total: float) -> np.ndarray:
    """Tokens asked for, by domain; those of absent domains are spread."""
    weight = np.array([targets.get(d, 0.0) for d in domains])
    return weight / weight.sum() * total if weight.sum() > 0 else np.full(len(domains), np.nan)


def _target(wanted: np.ndarray, now: np.ndarray, most: float) -> np.ndarray:
    """Target tokens by domain, of as many in all as the expected ones."""
    short = np.zeros(len(now), bool)
    while True:
        rest = np.where(short, 0.0, wanted)
        if not rest.sum() > 0:
            return now.copy()  # nothing can be asked for
        target = np.where(short, now, rest / rest.sum() * now[~short].sum())
        more = ~short & (target > most * now)
        if not more.any():
            return target
        short |= more


def _measured(table: DataFrame, k: int, steps: list[np.ndarray], trials: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each further step of ``trials``: half the sum of n r^2, the totals
    and the sum of n p p' over the documents with r > 0; one pass."""
    width = 1 + k + k * k

    def run(batches):
        total = np.zeros((len(trials), width))
        for b in batches:
            if b.num_rows:
                n, p = _arrays(b.column(0), b.column(1))
                for i, s in enumerate(trials):
                    r = _rates(n, p, [*steps, s])
                    total[i, 0] += 0.5 * (n * r * r).sum()
                    total[i, 1 : 1 + k] += (n * r) @ p
                    total[i, 1 + k :] += (p.T @ ((n * (r > 0))[:, None] * p)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros(len(trials) * width)
    for r in table.select("n_tokens", "p").mapInArrow(tidy(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # len(out) rows
        out[r["i"]] = r["v"]
    return [(x[0], x[1 : 1 + k], x[1 + k :].reshape(k, k)) for x in out.reshape(len(trials), width)]


def solve(table: DataFrame, domains: list[str], targets: dict[str, float], tolerance: float = TOLERANCE, most: float = MOST) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of the projected gradient, the target and the reached tokens."""
    k = len(domains)
    steps: list[np.ndarray] = []
    ((value, now, curve),) = _measured(table, k, steps, [np.zeros(k)])
    total = now.sum()
    target = _target(asked(targets, domains, total), now, most) if total > 0 and sum(targets.get(d, 0.0) for d in domains) > 0 else now.copy()
    damping = DAMPING * max(total, 1e-300)
    passes = 1
    while np.abs(now - target).max() > tolerance * total and passes < ROUNDS:
        # Newton's method on the step: the minimum of value + s . target + damping / 2 |s|^2
        s, before = np.zeros(k), np.linalg.norm(now - target)
        cost = value
        while passes < ROUNDS:
            slope = target - now + damping * s
            if np.abs(slope).max() <= 0.1 * tolerance * total:
                break
            way = -np.linalg.solve(curve + damping * np.eye(k), slope)
            trials = [s + t * way for t in TRIALS]
            found = _measured(table, k, steps, trials)
            passes += 1
            costs = [f[0] + t @ target + damping / 2 * t @ t for f, t in zip(found, trials, strict=True)]
            best = int(np.argmin(costs))
            if not costs[best] < cost:
                break
            cost, s, (value, now, curve) = costs[best], trials[best], found[best]
        steps.append(s)
        if np.linalg.norm(now - target) > (1 - STALL) * before:
            break
    return steps, target, now


OUTPUT = ["n_tokens", "p", "domain", "rate"]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, whole_rows: bool = False, doc_id: str = "doc_id", text: str = "text", most: float = MOST) -> DataFrame:
    """The id (``whole_rows``: all columns; those named as in OUTPUT are
    replaced) plus n_tokens, p (posteriors), domain (likeliest) and rate, a row
    per input row. Warns of domains in which the rates do not reach what is asked."""
    rows, totals = mixed(docs, labels, targets, whole_rows, doc_id, text, most)
    all_tokens = sum(x["target"] for x in totals)
    missed = [f"{x['domain']} {x['reached']:.0f} of {x['asked']:.0f}" for x in totals if abs(x["reached"] - x["asked"]) > TOLERANCE * all_tokens]
    if missed:
        warnings.warn(f"mixing rates do not reach the target tokens: {', '.join(missed)}", stacklevel=2)
    return rows


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, whole_rows: bool = False, doc_id: str = "doc_id", text: str = "text", most: float = MOST) -> tuple[DataFrame, list[dict]]:
    """The rows of ``mix``, and of each domain its asked, target and reached tokens."""
    model = fit(docs, labels, doc_id=doc_id, text=text)
    table = stored(posteriors(docs, model, [F.col(doc_id).alias("doc_id")], text), "softmix-posteriors")
    steps, target, now = solve(table, model["domains"], targets or TARGETS, most=most)
    wanted = asked(targets or TARGETS, model["domains"], target.sum())
    wanted = np.where(np.isnan(wanted), target, wanted)
    if whole_rows:
        table = posteriors(docs, model, [F.col(c) for c in docs.columns if c not in (*OUTPUT, "copies")], text)
    names = np.array(model["domains"], dtype=object)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    width = len(table.columns)

    def run(batches):
        for b in batches:
            if b.num_rows:
                n, p = _arrays(b.column(width - 2), b.column(width - 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[p.argmax(1)].tolist(), pa.string()), pa.array(_rates(n, p, steps))], names=[*b.schema.names, "domain", "rate"])

    totals = [{"domain": d, "asked": float(w), "target": float(a), "reached": float(b)} for d, w, a, b in zip(model["domains"], wanted, target, now, strict=True)]
    return table.mapInArrow(tidy(run), f"{fields}, domain string, rate double"), totals


def take(mixed: DataFrame, seed: int = 1, doc_id: str = "doc_id") -> DataFrame:
    """``mixed`` with ``copies``: the rate rounded up or down with the id's
    hash so that it is right on average; rows with none are left out."""
    u = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return mixed.withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("bigint")).cast("bigint")).filter("copies > 0")


def op6(spark, sf_dir: str) -> DataFrame:
    """Domain posteriors and mixing rate of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mix(docs, labels)
