"""License scans: word-bigram Dice coefficient against licence templates.

Every line of a text and the whole text are compared as sets of word bigrams
of the normalised text (lower case, letters and digits only). The coefficient
2|A and B| / (|A| + |B|) can reach the threshold t only if |A| lies between
t/(2-t) and (2-t)/t times |B|, so templates, sorted by size, outside these
bounds are never compared; without such a template a line costs its split only.

Complete licence texts and notices that are wrapped, or part of a longer line,
lie across lines. So every run of as many words as a template has is compared
with it, too, if the text holds enough of the template's bigrams for the
threshold at all. Windows are reported in addition to lines: by the bigrams
shared less those that differ, none inside a better match.

Texts are independent rows: a map without a shuffle, memory by text.

Defined cases: null and empty texts match nothing; a text or template of one
word has that word as its only unit; equal scores go to the first template by
name; repeated rows are treated alike; an empty table gives an empty table. The
result columns replace columns of the same name, others stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")

#: (name, family, text): short notices and the opening grants of well-known licences.
TEMPLATES = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "proprietary", "All rights reserved."),
)

#: (name, family, text): the notices that the licences ask for in a file's head.
HEADERS = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "copyleft", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "copyleft", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

#: Complete texts in license_texts, by name, with their families.
COMPLETE = {
    "Apache-2.0": "permissive", "Artistic-1.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "CC0-1.0": "permissive",
    "GFDL-1.2": "copyleft", "GFDL-1.3": "copyleft", "GPL-1.0": "copyleft", "GPL-2.0": "copyleft", "GPL-3.0": "copyleft", "ISC": "permissive",
    "LGPL-2.0": "copyleft", "LGPL-2.1": "copyleft", "LGPL-3.0": "copyleft", "MIT": "permissive", "MPL-1.1": "copyleft", "MPL-2.0": "copyleft",
}


@lru_cache(maxsize=1)
def long_templates() -> tuple[tuple[str, str, str], ...]:
    """(name, family, text) of the headers and the complete texts; only windows are compared with them."""
    folder = files(__package__) / "license_texts"
    return (*HEADERS, *((name, family, (folder / f"{name}.txt").read_text("utf-8")) for name, family in COMPLETE.items()))


def bigrams(words: list[str]) -> frozenset:
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


class Templates:
    """Templates sorted by the size of their bigram sets."""

    def __init__(self, texts: tuple[tuple[str, str, str], ...], threshold: float, long: tuple[tuple[str, str, str], ...] = ()) -> None:
        self.threshold = threshold
        made = sorted(((len(b), name, family, b) for name, family, text in texts if (b := bigrams(WORD.findall(text.lower())))), key=lambda x: x[:3])
        self.rows, self.sizes = made, [m[0] for m in made]
        t = threshold
        self.least = self.sizes[0] * t / (2 - t) if made else 0
        self.most = self.sizes[-1] * (2 - t) / t if made else -1
        #: (name, family, words, bigrams) of what windows are compared with, and which of them hold a bigram
        self.runs = [(name, family, len(w), bigrams(w)) for name, family, text in (*texts, *long) if len(w := WORD.findall(text.lower())) > 1]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, run in enumerate(self.runs):
            for g in run[3]:
                self.holders.setdefault(g, []).append(k)

    def best(self, units: frozenset) -> tuple[float, str, str, int] | None:
        """(score, name, family, size) of the most similar template at or above the threshold."""
        n, t, found = len(units), self.threshold, None
        low, high = bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        for size, name, family, template in self.rows[low:high]:
            score = 2 * len(units & template) / (n + size)
            if score >= t and (found is None or (-score, name) < (-found[0], found[1])):
                found = (score, name, family, size)
        return found

    def scan(self, text: str) -> list[tuple[str, str, float, int]]:
        """(name, family, score, 1-based line; 0 for the whole text) of every match."""
        out = []
        lines = text.lower().split("\n")
        whole: list[str] = []
        begins, spans = [], []  # first word of each line; (worth, first word, end) of matches
        for k, line in enumerate(lines, 1):
            words = WORD.findall(line)
            begins.append(len(whole))
            whole += words
            # distinct bigrams are at most the words, so a shorter line can't reach the smallest template
            if len(words) >= self.least and words:
                units = bigrams(words)
                hit = self.best(units)
                if hit:
                    out.append((hit[1], hit[2], hit[0], k))
                    spans.append((_worth(hit[0], len(units) + hit[3]), begins[-1], len(whole)))
        if len(lines) > 1 and whole:
            units = bigrams(whole)
            hit = self.best(units) if self.least <= len(units) <= self.most else None
            if hit:
                out.append((hit[1], hit[2], hit[0], 0))
                spans.append((_worth(hit[0], len(units) + hit[3]), 0, len(whole)))
        out.extend((name, family, score, bisect_right(begins, at)) for at, name, family, score in self.windows(whole, spans))
        return out

    def windows(self, words: list[str], spans: list[tuple[float, int, int]]) -> list[tuple[int, str, str, float]]:
        """(first word, name, family, score) of every window that matches, in order, outside better windows and `spans`."""
        grams = list(zip(words, words[1:]))
        held = Counter(k for g in self.holders.keys() & set(grams) for k in self.holders[g])
        least = self.threshold / (2 - self.threshold)
        able = [k for k, n in held.items() if n >= len(self.runs[k][3]) * least - 1e-9]
        if not able:
            return []
        last: dict[tuple[str, str], int] = {}
        before = np.empty(len(grams), np.int64)  # where a bigram was last seen
        for j, g in enumerate(grams):
            before[j] = last.get(g, -1)
            last[g] = j
        every, found = np.arange(len(grams)), []
        for k in able:
            name, family, n_words, template = self.runs[k]
            width = min(n_words - 1, len(grams))
            common = _distinct(np.array([j for j, g in enumerate(grams) if g in template]), before, width)
            total = _distinct(every, before, width) + len(template)
            score = 2 * common / total
            found += [(-_worth(score[i], total[i]), -score[i], name, i, i + width + 1, family) for i in np.flatnonzero(score >= self.threshold).tolist()]
        taken, rest, out = bytearray(len(words)), sorted(spans), []
        for worth, score, name, start, end, family in sorted(found):
            while rest and rest[-1][0] >= -worth - 1e-9:
                _, a, b = rest.pop()
                taken[a:b] = b"\1" * (b - a)
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                out.append((start, name, family, float(-score)))
        return sorted(out)


def _worth(score: float, sizes: int) -> float:
    """Bigrams shared less those in one set only, of a Dice coefficient and the sum of both sizes."""
    return float((1.5 * score - 1) * sizes)


def _distinct(at: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    """How many distinct bigrams of those at the places `at` each window of `width` bigrams holds."""
    steps = np.zeros(len(before) + 1, np.int64)
    # a bigram counts in the windows that hold its place but not the one before
    np.add.at(steps, np.maximum(before[at], np.maximum(at - width, -1)) + 1, 1)
    np.add.at(steps, at + 1, -1)
    return np.cumsum(steps)[: len(before) - width + 1]


MATCHES = "array<struct<license:string,family:string,score:double,line:int>>"
_TYPE = pa.list_(pa.struct([("license", pa.string()), ("family", pa.string()), ("score", pa.float64()), ("line", pa.int32())]))


def _scan(templates: tuple, threshold: float, complete: bool, place: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = Templates(templates, threshold, long_templates() if complete else ())
    keys = ("license", "family", "score", "line")
    for batch in slices(batches, place):
        found = [[dict(zip(keys, m, strict=True)) for m in table.scan(t or "")] for t in batch.column(place).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, _TYPE)], names=[*names, "matches"])


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None, complete: bool = True) -> DataFrame:
    """docs (or its columns `keep`), scanned for the templates and, if `complete`, the headers and complete texts, with matches, n_matches, licenses (sorted, distinct) and best_score (0 without a match)."""
    made = ("matches", "n_matches", "licenses", "best_score")
    names = [c for c in keep or docs.columns if c not in made]
    read = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)), F.col(text).alias("_text"))
    inner = [f"c{k}" for k in range(len(names))]
    fields = [f"{n} {read.schema[n].dataType.simpleString()}" for n in inner]
    out = read.mapInArrow(partial(_scan, templates, threshold, complete, len(names), inner), ", ".join([*fields, f"matches {MATCHES}"]))
    return out.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(names)),
        "matches",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_sort(F.array_distinct("matches.license")).alias("licenses"),
        F.coalesce(F.array_max("matches.score"), F.lit(0.0)).alias("best_score"),
    )
