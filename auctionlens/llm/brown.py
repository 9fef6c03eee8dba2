"""Operator 2: language-model scores by a Brown class bigram model.

Every token of the corpus has a class. Exchange clustering of a seed, on the
driver, moves one atom at a time to the class that raises the likelihood of
the class bigrams most, until nothing moves: atoms are the ``TOP_WORDS`` most
frequent training words, and the endings (last three bytes, hashed) of all
others. Every further training word that occurs ``FLOOR`` times or more then
leaves its ending and gets its own best class, in Spark, from the counts of
the seed classes before and after it: the class with the highest likelihood
of those neighbours and the word itself. Only words that occur less often,
and unknown words, have their ending's class; they estimate the chance of an
unseen word. The class bigrams are counted anew with the final classes. A
text's probability is

    product of  P(class | class before) * P(atom | class) * P(word | atom)

with the end token's class before the first token; the further words of a
class are one atom of it. All three factors are smoothed and each sums to
one: classes towards their unigram, atoms by an added constant, the words of
an ending by (c + 0.5) / (N_atom + 0.5 (V_atom + 1)), which leaves every
ending atom the chance of an unseen word; further words are c / N_atom.

All counts cover all training documents: one pass counts words, one counts
atom bigrams (at most ``ATOMS ** 2`` cells, for the seed alone), one the
neighbours of each further word, one the final class bigrams, and one scores.
Counts and classes of the ``HEAD`` most frequent words, a bounded table, go to
the tasks; those of all others are joined by shuffle, a row for each
document and distinct word, so very common words are never shuffled by key
and the vocabulary is never collected.

Words are compared by a 64-bit hash of their bytes. Defined cases: null text
is empty (its only token is the end); rows with a null id are scored but not
learned from and held_out is false; every input row gives one output row;
without training documents all words are unknown; other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, VISIBLE, crc_mod, hash_words, row_sums, span_hashes, stored, text_blocks, words

TOP_WORDS = 1024
ENDINGS = 512
ATOMS = TOP_WORDS + ENDINGS
CLASSES = 48
FLOOR = 2  # a word that occurs once tells the chance of an unseen one
HEAD = 1 << 17
END = hash_words([b"\n"])  # no word holds a line break

MERGE_TOKENS = 4_000_000


def _tokens(raw: np.ndarray, offs: np.ndarray):
    """Word hashes and ending buckets of a block, with the end token after
    each row, and the rows' bounds."""
    buf = LOWER[raw]
    starts, ends, rows = words(buf, offs, VISIBLE)
    word, tail = span_hashes(buf, [(starts, ends), (np.maximum(starts, ends - 3), ends)]) if len(starts) else (np.zeros(0, np.uint64),) * 2
    bounds = rows + np.arange(len(rows))
    at = np.ones(bounds[-1], bool)
    at[bounds[1:] - 1] = False
    h, e = np.full(bounds[-1], END[0]), np.zeros(bounds[-1], np.int64)
    h[at] = word
    e[at] = (tail % np.uint64(ENDINGS)).astype(np.int64)
    return h, e, bounds


def word_counts(texts: DataFrame) -> DataFrame:
    """h (word hash), e (ending), c (count) of all tokens of ``text``."""

    def run(batches):
        def merged(parts):
            h = np.concatenate([p[0] for p in parts])
            at = np.argsort(h, kind="stable")
            h, e, c = h[at], np.concatenate([p[1] for p in parts])[at], np.concatenate([p[2] for p in parts])[at]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], e[first], np.add.reduceat(c, first)

        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["h", "e", "c"])

        parts, size = [], 0
        for b in batches:
            for _, _, raw, offs in text_blocks(b.column(0)):
                h, e, _ = _tokens(raw, offs)
                parts.append((h, e, np.ones(len(h), np.int64)))
                parts[-1] = merged(parts[-1:])
                size += len(parts[-1][0])
                if size > MERGE_TOKENS:
                    x = merged(parts)
                    parts, size = [x], len(x[0])
                    if size > MERGE_TOKENS // 2:
                        yield out(x)
                        parts, size = [], 0
        if parts:
            yield out(merged(parts))

    return texts.select("text").mapInArrow(run, "h bigint, e int, c bigint").groupBy("h").agg(F.first("e").alias("e"), F.sum("c").alias("c"))


class Atoms:
    """Atom of each token: its place among the top words, or its ending's."""

    def __init__(self, top: np.ndarray):
        self.order = np.argsort(top)
        self.sorted = top[self.order]

    def of(self, h: np.ndarray, e: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return TOP_WORDS + e
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], TOP_WORDS + e)


def bigram_counts(texts: DataFrame, atoms: Atoms) -> np.ndarray:
    """ATOMS x ATOMS counts of neighbouring atoms; each text starts after an end token."""
    end = int(atoms.of(END, np.zeros(1, np.int64))[0])

    def run(batches):
        total = np.zeros(ATOMS * ATOMS, np.int32)
        for b in batches:
            for _, _, raw, offs in text_blocks(b.column(0)):
                h, e, bounds = _tokens(raw, offs)
                a = atoms.of(h, e)
                before = np.empty_like(a)
                before[1:] = a[:-1]
                before[bounds[:-1]] = end
                cell, n = np.unique(before * ATOMS + a, return_counts=True)
                total[cell] += n.astype(np.int32)
        cell = np.flatnonzero(total)
        for lo in range(0, len(cell), 1 << 18):
            part = cell[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], names=["cell", "c"])

    rows = texts.select("text").mapInArrow(run, "cell int, c bigint").groupBy("cell").agg(F.sum("c").alias("c"))
    got = rows.toArrow()  # at most ATOMS ** 2 rows
    out = np.zeros(ATOMS * ATOMS)
    out[got.column("cell").to_numpy()] = got.column("c").to_numpy()
    return out.reshape(ATOMS, ATOMS)


def word_classes(texts: DataFrame, atoms: Atoms, cls: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """h, cls: the best class of each training word that is no top word and
    occurs FLOOR times or more, by its neighbours' seed classes ``cls``;
    ``pairs`` are the seed's class bigrams."""
    _, follow = _follow(pairs)
    follow, size = np.log(follow), np.log(pairs.sum(0) + 0.5)
    gain = np.concatenate([follow, follow.T])  # from each class before, to each class after

    def merged(parts):
        h, code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.lexsort((code, h))
        h, code = h[at], code[at]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])]))
        return h[first], code[first], np.add.reduceat(n[at], first)

    def neighbours(batches):
        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int16)), pa.array(x[2])], names=["h", "code", "n"])

        parts, size = [], 0
        for b in batches:
            for _, _, raw, offs in text_blocks(b.column(0)):
                h, e, bounds = _tokens(raw, offs)
                a = atoms.of(h, e)
                c = cls[a].astype(np.int16)
                before, after = np.roll(c, 1), np.roll(c, -1)
                before[bounds[:-1]], after[bounds[1:] - 1] = c[bounds[1:] - 1], c[bounds[:-1]]
                rare = a >= TOP_WORDS
                if not rare.any():
                    continue
                code = np.concatenate([before[rare], after[rare] + np.int16(CLASSES)])
                parts.append(merged([(np.tile(h[rare], 2), code, np.ones(len(code), np.int64))]))
                size += len(parts[-1][0])
                if size > MERGE_TOKENS:
                    x = merged(parts)
                    parts, size = [x], len(x[0])
                    if size > MERGE_TOKENS // 2:
                        yield out(x)
                        parts, size = [], 0
        if parts:
            yield out(merged(parts))

    def best(h, code, n):
        new = np.concatenate([[True], h[1:] != h[:-1]])
        word = np.cumsum(new) - 1
        seen = np.bincount(word * 2 * CLASSES + code, weights=n, minlength=(word[-1] + 1) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
        times = seen[:, :CLASSES].sum(1)
        chosen = (seen @ gain - times[:, None] * size).argmax(1)
        keep = times >= FLOOR
        return pa.RecordBatch.from_arrays([pa.array(h[new][keep]), pa.array(chosen[keep].astype(np.int32))], names=["h", "cls"])

    def choose(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for b in batches:
            if not b.num_rows:
                continue
            got = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, b.columns, strict=True)]
            cut = int(np.searchsorted(got[0], got[0][-1]))  # the last word may go on
            rest = [x[cut:] for x in got]
            if cut:
                yield best(*(x[:cut] for x in got))
        if len(rest[0]):
            yield best(*rest)

    rows = texts.select("text").mapInArrow(neighbours, "h bigint, code smallint, n bigint")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(choose, "h bigint, cls int")


def _follow(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed unigram of the classes and chances of each class after each."""
    unigram = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
    return unigram, (pairs + 2.0 * unigram) / (pairs.sum(1, keepdims=True) + 2.0)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int = CLASSES, rounds: int = 15) -> np.ndarray:
    """Class of each atom by the exchange algorithm: maximises
    sum n(c, d) log n(c, d) - 2 sum n(c) log n(c) over the class bigrams."""
    n = len(counts)
    weight = counts.sum(0)
    order = np.argsort(-weight, kind="stable")
    cls = np.empty(n, int)
    cls[order] = np.arange(n) % classes
    onehot = np.eye(classes)[cls]
    big = onehot.T @ counts @ onehot
    after, before = counts @ onehot, counts.T @ onehot  # (n, classes): to and from each class
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not weight[w] and not counts[w].any():
                continue
            old, own = cls[w], counts[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[old] -= own
            into[old] -= own
            rest = big.copy()  # without the atom
            rest[old] -= out
            rest[:, old] -= into
            rest[old, old] -= own
            # class totals with the atom's neighbours: they stay wherever it goes
            row, col = rest.sum(1) + into, rest.sum(0) + out
            # gain of each class d that the atom could join
            joined_row, joined_col = rest + out, rest + into[:, None]
            gain = (_xlogx(joined_row) - _xlogx(rest)).sum(1) + (_xlogx(joined_col) - _xlogx(rest)).sum(0)
            diag = np.diag(rest)
            gain += _xlogx(diag + out + into + own) - _xlogx(diag + out) - _xlogx(diag + into) + _xlogx(diag)
            so, si = out.sum() + own, into.sum() + own
            gain -= _xlogx(row + so) - _xlogx(row) + _xlogx(col + si) - _xlogx(col)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                continue
            moved += 1
            cls[w] = new
            big = rest
            big[new] += out
            big[:, new] += into
            big[new, new] += own
            after[:, old] -= counts[:, w]
            after[:, new] += counts[:, w]
            before[:, old] -= counts[w]
            before[:, new] += counts[w]
        if not moved:
            break
    return cls


def fit(docs: DataFrame, train_filter: Column, text: str = "text") -> tuple[dict, DataFrame]:
    """The model and the table of all training words' counts (h, e, c)."""
    training = docs.filter(F.coalesce(train_filter, F.lit(False))).select(F.col(text).alias("text"))
    counts = stored(word_counts(training), "brown-counts")
    # the frequent words: all whose count is in the top classes of counts, as
    # far down as HEAD rows reach; nothing is sorted in one task
    level = F.floor(F.log2(F.col("c")) * 8)
    sizes = counts.groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("l")).collect()  # a row for each eighth of a doubling
    floor, room = None, HEAD
    for r in sizes:
        if r["n"] > room:
            break
        floor, room = r["l"], room - r["n"]
    head = counts.filter(level >= floor if floor is not None else F.lit(False)).toArrow()  # at most HEAD rows
    h, c = head.column("h").to_numpy(), head.column("c").to_numpy()
    at = np.lexsort((h, -c))
    h, c = h[at].astype(np.int64), c[at].astype(np.int64)
    top = h[:TOP_WORDS].view(np.uint64)
    atoms = Atoms(top)
    n, v = sum(r["c"] for r in sizes), sum(r["n"] for r in sizes)
    big = bigram_counts(training, atoms)
    seed = exchange(big)
    onehot = np.eye(CLASSES)[seed]
    classes = word_classes(training, atoms, seed, onehot.T @ big @ onehot)
    counts = stored(counts.join(classes, "h", "left").select("h", "e", "c", "cls"), "brown-classes")
    found = counts.filter(level >= floor if floor is not None else F.lit(False)).select("h", F.coalesce("cls", F.lit(-1)).alias("cls")).toArrow()  # the head again
    at = np.argsort(found.column("h").to_numpy())
    by = np.argsort(h)
    head_cls = np.empty(len(h), np.int64)
    head_cls[by] = found.column("cls").to_numpy()[at]
    # tokens and words that each ending keeps, tokens of each class's further words
    own, members = np.zeros((2, ENDINGS)), np.zeros(CLASSES)
    rare = counts
    if len(top):
        least, last = int(c[len(top) - 1]), int(h[len(top) - 1])
        rare = counts.filter((F.col("c") < least) | ((F.col("c") == least) & (F.col("h") > last)))
    kept = F.when(F.col("cls").isNull(), F.col("e"))
    for r in rare.groupBy(kept.alias("e"), "cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # at most ENDINGS + CLASSES rows
        if r["cls"] is None:
            own[:, r["e"]] = r["n"], r["v"]
        else:
            members[r["cls"]] = r["n"]
    cls = np.concatenate([seed, np.arange(CLASSES)])
    mass = np.zeros(ATOMS + CLASSES)
    mass[: len(top)] = c[: len(top)]
    mass[TOP_WORDS:ATOMS], mass[ATOMS:] = own[0], members
    mass += 0.5
    emit = mass / np.bincount(cls, mass, CLASSES)[cls]
    model = {
        "top": top,
        "cls": cls,
        "emit": np.log10(emit),
        "ending": np.log10(own[0] + 0.5 * (own[1] + 1)),
        "members": np.log10(np.maximum(members, 1)),
        "head": h.view(np.uint64),
        "head_c": c.astype(np.float64),
        "head_cls": head_cls,
        "n": int(n),
        "base": float(np.log10(n + 0.5 * (v + 1))),
    }
    model["follow"] = np.log10(_follow(class_bigrams(_coded(training, model, counts), model))[1])
    return model, counts


TAIL = 255  # the code of a token that the head does not hold


def _word_terms(model: dict, c: np.ndarray, own: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and log10 P(atom | class) P(word | atom) of words that are no top
    words: their counts, own classes (-1: none) and endings."""
    has, atom = own >= 0, np.where(own >= 0, ATOMS + own, TOP_WORDS + e)
    word = np.where(has, np.log10(np.maximum(c, 1)) - model["members"][np.maximum(own, 0)], np.log10(c + 0.5) - model["ending"][e])
    return model["cls"][atom], model["emit"][atom] + word


def _coded(src: DataFrame, model: dict, counts: DataFrame) -> DataFrame:
    """Last column (text) replaced by what it holds: n_known, base and word
    (sums over its head words), codes (a byte a token: its class or TAIL),
    places (for each TAIL token, in order, the place of its word in ends), ends
    (the endings of the distinct words that the head does not hold) and found
    (place, count and class of those words that training has)."""
    row = "_row"
    keys = src.columns[:-1]
    src = src.select(F.monotonically_increasing_id().alias(row), *(src[k] for k in src.columns))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    atoms = Atoms(model["top"])
    by = np.argsort(model["head"])
    head, head_c, head_cls = model["head"][by], model["head_c"][by], model["head_cls"][by]

    def run(batches):
        for b in batches:
            for lo, hi, raw, offs in text_blocks(b.column(b.num_columns - 1)):
                h, e, bounds = _tokens(raw, offs)
                a = atoms.of(h, e)
                at = np.minimum(np.searchsorted(head, h), max(len(head) - 1, 0))
                in_head = head[at] == h if len(head) else np.zeros(len(h), bool)
                seen = np.where(in_head, head_c[at], 0.0) if len(head) else np.zeros(len(h))
                own = np.where(in_head, head_cls[at], -1) if len(head) else np.full(len(h), -1)
                cls, word = _word_terms(model, seen, own, e)
                top = a < TOP_WORDS
                cls[top], word[top] = model["cls"][a[top]], model["emit"][a[top]]
                codes = np.where(in_head, cls, TAIL).astype(np.uint8)
                first = bounds[:-1]
                known = np.add.reduceat(in_head.astype(np.int64), first)
                base = np.add.reduceat(np.where(in_head, np.log10(seen + 0.5), 0.0) - model["base"], first)
                word = np.add.reduceat(np.where(in_head, word, 0.0), first)
                # what the head does not hold: a place for each text and word
                out = np.flatnonzero(~in_head)
                row_of = np.searchsorted(bounds, out, "right") - 1
                order = np.lexsort((h[out], row_of))
                sr, sh = row_of[order], h[out][order]
                new = np.concatenate([[True], (sr[1:] != sr[:-1]) | (sh[1:] != sh[:-1])]) if len(sh) else np.zeros(0, bool)
                cut = np.searchsorted(sr[new], np.arange(len(first) + 1))
                places = np.empty(len(out), np.int32)
                places[order] = np.cumsum(new) - 1 - cut[sr] if len(sh) else 0
                offsets = pa.array(cut.astype(np.int32))
                tail_at = pa.array(np.searchsorted(row_of, np.arange(len(first) + 1)).astype(np.int32))
                arrays = [
                    *(col.slice(lo, hi - lo) for col in b.columns[:-1]),
                    pa.array(known),
                    pa.array(base),
                    pa.array(word),
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(codes)]),
                    pa.ListArray.from_arrays(tail_at, pa.array(places)),
                    pa.ListArray.from_arrays(offsets, pa.array(e[out][order][new].astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(sh[new].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:-1], *CODED, "hashes"])

    rows = stored(src.mapInArrow(run, f"{fields}, n_known bigint, base double, word double, codes binary, places array<int>, ends array<int>, hashes array<bigint>"), "brown-coded")
    left = rows.select(row, F.posexplode("hashes").alias("place", "h"))
    found = left.join(counts.select("h", "c", "cls"), "h").groupBy(row).agg(F.collect_list(F.struct("place", F.col("c").cast("double").alias("c"), F.coalesce("cls", F.lit(-1)).alias("cls"))).alias("found"))
    return rows.drop("hashes").join(found, row, "left").select(*keys, *CODED, "found")


CODED = ["n_known", "base", "word", "codes", "places", "ends"]


def _filled(b: pa.RecordBatch, model: dict) -> tuple[np.ndarray, ...]:
    """Of a batch of ``_coded`` rows: the class of each token, the rows' bounds,
    and n_known, base and word of whole rows."""
    col = {k: b.column(i + b.num_columns - len(CODED) - 1) for i, k in enumerate([*CODED, "found"])}
    codes = col["codes"].cast(pa.large_binary())
    bounds = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1]
    cls = np.frombuffer(codes.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.int64)
    bounds = bounds - bounds[0]

    def spread(x):
        sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy()
        return np.concatenate([[0], np.cumsum(sizes)]), x.flatten()

    tail_bounds, places = spread(col["places"])
    word_bounds, e = spread(col["ends"])
    found_bounds, found = spread(col["found"])
    e = e.to_numpy()
    c, own = np.zeros(len(e)), np.full(len(e), -1)
    at = np.repeat(word_bounds[:-1], np.diff(found_bounds)) + found.field("place").to_numpy()
    c[at], own[at] = found.field("c").to_numpy(), found.field("cls").to_numpy()
    word_cls, word = _word_terms(model, c, own, e)
    at = np.repeat(word_bounds[:-1], np.diff(tail_bounds)) + places.to_numpy()
    cls[cls == TAIL] = word_cls[at]
    sums = [x.to_numpy() + row_sums(y[at], tail_bounds) for x, y in ((col["n_known"], c > 0), (col["base"], np.log10(c + 0.5)), (col["word"], word))]
    return cls, bounds, *sums


def _before(cls: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Class before each token: before the first stands that of the end token,
    a text's last."""
    before = np.roll(cls, 1)
    before[bounds[:-1]] = cls[bounds[1:] - 1]
    return before


def class_bigrams(coded: DataFrame, model: dict) -> np.ndarray:
    """CLASSES x CLASSES counts of neighbouring classes, by the final classes."""

    def run(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            if b.num_rows:
                cls, bounds, *_ = _filled(b, model)
                total += np.bincount(_before(cls, bounds) * CLASSES + cls, minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES * CLASSES, dtype=np.int32)), pa.array(total)], names=["cell", "c"])

    out = np.zeros(CLASSES * CLASSES)
    for r in coded.mapInArrow(run, "cell int, c bigint").groupBy("cell").agg(F.sum("c").alias("c")).collect():  # CLASSES ** 2 rows
        out[r["cell"]] = r["c"]
    return out.reshape(CLASSES, CLASSES)


def score(docs: DataFrame, model: dict, counts: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10)."""
    src = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:2])

    def run(batches):
        for b in batches:
            if b.num_rows:
                cls, bounds, known, base, word = _filled(b, model)
                total = word + row_sums(model["follow"][_before(cls, bounds), cls], bounds)
                arrays = [*b.columns[:2], pa.array(np.diff(bounds)), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(len(known), model["n"])), pa.array(base), pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _coded(src, model, counts).mapInArrow(run, f"{fields}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op2(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, learned where crc32(doc_id) mod 5 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, counts = fit(docs, crc_mod("doc_id", 5) != 1)
    return score(docs, model, counts, F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)))
