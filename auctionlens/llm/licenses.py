"""Operator 10: license scans by template-markup matching.

A template is a license's wording with markup: ``[ ... ]`` is optional and
``{name:a-b}`` is replaceable by ``a`` to ``b`` words. Each is compiled to a
token automaton (epsilon moves past optional regions, counted wildcard moves
for replaceable ones) which accepts a run of words whose mandatory wording
matches exactly, word for word, after ASCII lower-casing; punctuation and
layout play no part, as words leave them out. A template must begin with two
mandatory words; these start an attempt. ``TEXTS`` hold all the wording of a
license, ``NOTICES`` its headers and the sentences that refer to it.

Base phrases are found as places where their words stand consecutively. The
hash of each word pair is compared with the pairs that start a phrase or a
template over the whole text, and only at such places are words read, so a
text costs one hash a word.

Score: 1 if a template matches; else 0.5 if a base phrase stands in the
text; else the share of license vocabulary seen (0 if none), times 0.4.

Defined cases: null text is empty; every input row gives one output row,
repeated rows too; without labels the label strings are empty; other columns
are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ALNUM, LOWER, gram_hashes, hash_words, text_blocks, word_hashes, words

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Whole public license texts, from the grant to the end of the
# disclaimer, with markup.
TEXTS = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and [associated] documentation files [the software] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors [or copyright holders] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc": ["permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {author:1-12} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {author:1-12} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "bsd-2-clause": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by {holder:1-20} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {holder:1-20} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "bsd-3-clause": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [3] neither the name of {holder:1-12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by {holder:1-20} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {holder:1-20} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors [or copyright holders] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
}

# Headers and notices that name a license, with markup; for the
# licenses that TEXTS lacks they are all that is known.
NOTICES = {
    "mit": [
        "released under the [terms of the] mit license",
        "licensed under the [terms of the] mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 [the license] you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "licensed under the apache license version 2 0",
    ],
    "gpl-2": [
        "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2",
    ],
    "gpl-3": [
        "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl": [
        "licensed under the [terms of the] gnu lesser general public license",
    ],
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "cc-by": ["licensed under [a] [the] [creative commons] cc by {version:1-1} 0"],
    "cc-by-sa": ["licensed under [a] [the] [creative commons] cc by sa {version:1-1} 0"],
    "cc-by-nc": ["licensed under [a] [the] [creative commons] cc by nc {version:1-1} 0"],
    "cc0": ["to the extent possible under law {author:1-12} has waived all copyright and related or neighboring rights to"],
}

TEMPLATES = {label: TEXTS.get(label, []) + NOTICES.get(label, []) for label in dict.fromkeys([*TEXTS, *NOTICES])}

# Words that speak of licenses, for the score of texts without a match.
VOCABULARY = ["license", "licensed", "licenses", "licence", "copyright", "permission", "redistribution", "warranty", "gnu", "apache", "sublicense"]

_MARKUP = re.compile(r"\[|\]|\{\w+:\d+-\d+\}|[^\s\[\]{}]+")


def compile_template(markup: str) -> dict:
    """Automaton: ``word[s]`` is the word that leads from state s to s + 1
    (None: any), ``skip[s]`` the states reachable without a word."""
    steps: list[str | None] = []
    skip: list[tuple[int, int]] = []
    open_at: list[int] = []
    for t in _MARKUP.findall(markup):
        if t == "[":
            open_at.append(len(steps))
        elif t == "]":
            skip.append((open_at.pop(), len(steps)))
        elif t[0] == "{":
            low, high = map(int, t.rstrip("}").split(":")[1].split("-"))
            start = len(steps)
            steps += [None] * high
            skip += [(s, len(steps)) for s in range(start + low, len(steps))]
        else:
            steps.append(t)
    if open_at or len(steps) < 2 or any(a < 2 for a, _ in skip) or None in steps[:2]:
        raise ValueError(f"a template begins with two mandatory words and closes its brackets: {markup}")
    reach: list[tuple[int, ...]] = []
    for s in range(len(steps) + 1):
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for a, z in skip:
                if a == x and z not in seen:
                    seen.add(z)
                    todo.append(z)
        reach.append(tuple(sorted(seen)))
    return {"words": steps, "reach": reach}


def match(automaton: dict, text: list[str], start: int) -> int | None:
    """End of the shortest accepted run of words from ``start``; None if there is none."""
    steps, reach = automaton["words"], automaton["reach"]
    states = set(reach[0])
    for i in range(start, len(text)):
        if len(steps) in states:
            return i
        states = {y for s in states if s < len(steps) and (steps[s] is None or steps[s] == text[i]) for y in reach[s + 1]}
        if not states:
            return None
    return len(text) if len(steps) in states else None


class _Words:
    """Words of one row, read from the block on demand."""

    def __init__(self, buf, starts, ends):
        self.buf, self.starts, self.ends = buf, starts, ends

    def __len__(self):
        return len(self.starts)

    def __getitem__(self, i):
        return self.buf[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, vocabulary: list[str] = VOCABULARY):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.templates = [(compile_template(m), label) for label, many in templates.items() for m in many]
        self.by_pair: dict[int, list[tuple[bool, int]]] = {}
        for base, items in ((True, [p for p, _ in self.phrases]), (False, [a["words"] for a, _ in self.templates])):
            for i, w in enumerate(items):
                if len(w) < 2:
                    raise ValueError("a phrase has at least two words")
                pair = int(gram_hashes(hash_words([x.encode() for x in w[:2]]), 2)[0])
                self.by_pair.setdefault(pair, []).append((base, i))
        self.pairs = np.array(sorted(self.by_pair), np.uint64)
        self.vocabulary = np.sort(hash_words([x.encode() for x in vocabulary]))

    def scan(self, column: pa.Array) -> list[tuple]:
        """Per text: n_words, n_base, first and last word, base labels, labels, score, spans."""
        out = []
        for lo, hi, raw, offs in text_blocks(column):
            buf = LOWER[raw]
            starts, ends, rows = words(buf, offs, ALNUM)
            h = word_hashes(buf, starts, ends)
            at = np.flatnonzero(np.isin(gram_hashes(h, 2), self.pairs))
            said = np.isin(h, self.vocabulary)
            pair_row = np.searchsorted(rows, at, "right") - 1
            by_row: dict[int, list[int]] = {}
            for p, r in zip(at.tolist(), pair_row.tolist(), strict=True):
                by_row.setdefault(r, []).append(p)
            for r in range(hi - lo):
                a, z = int(rows[r]), int(rows[r + 1])
                base, spans = [], []
                text = _Words(buf, starts[a:z], ends[a:z])
                for p in by_row.get(r, ()):
                    i = p - a
                    if i + 1 >= len(text):
                        continue
                    pair = int(gram_hashes(h[p : p + 2], 2)[0])
                    for is_base, n in self.by_pair[pair]:
                        if is_base:
                            phrase, label = self.phrases[n]
                            if i + len(phrase) <= len(text) and all(text[i + j] == w for j, w in enumerate(phrase)):
                                base.append((i, label))
                        else:
                            end = match(self.templates[n][0], text, i)
                            if end is not None:
                                spans.append((i, end, self.templates[n][1]))
                labels = sorted({x for _, x in base} | {x for _, _, x in spans})
                share = len(np.unique(h[a:z][said[a:z]])) / len(self.vocabulary)
                score = 1.0 if spans else 0.5 if base else 0.4 * share
                places = [i for i, _ in base]
                out.append((z - a, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), score, spans))
        return out


def scan(docs: DataFrame, keys: list, text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """``keys`` plus the columns of the contract and ``matches`` (word spans
    of accepted templates), a row per input row."""
    scanner = scanner or Scanner()
    src = docs.select(*keys, docs[text].alias("_text"))
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())])
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), T.ArrayType(span)]
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]

    def run(batches):
        for b in batches:
            found = scanner.scan(b.column(b.num_columns - 1))
            cols = [[x[i] for x in found] for i in range(len(names))]
            cols[-1] = [[{"first": s, "end": e, "label": n} for s, e, n in x] for x in cols[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, arrow, strict=True))], names=schema.names)

    return src.mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    """License places and labels of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]).drop("matches")
