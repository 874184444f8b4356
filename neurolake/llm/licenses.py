"""License scan by patience alignment (operator 3)."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from neurolake.llm import _frames, _text

COVERAGE = 0.8
DENSITY = 0.5

# The templates, public licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that increases in both, of pairs sorted by the first; by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        tops[k : k + 1] = [y]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched positions (text, template): words unique to both are anchors, gaps between them are aligned the same way; a gap
    without anchors gives its equal beginning and end."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[text[i]] = -1 if text[i] in once else i
        mine: dict[int, int] = {}
        for j in range(b0, b1):
            mine[template[j]] = -1 if template[j] in mine else j
        pairs = sorted((i, mine[w]) for w, i in once.items() if i >= 0 and mine.get(w, -1) >= 0)
        chain = increasing(pairs)
        if chain:
            out += chain
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
            continue
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
    return sorted(out)


class Scanner:
    """Finds templates in texts: a bound on the coverage from word counts first, then alignment near the rarest shared words."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, density: float = DENSITY):
        self.names = sorted(templates)
        self.coverage, self.density = coverage, density
        said = {n: _WORD.findall(templates[n].encode().lower()) for n in self.names}
        if not all(said.values()):
            raise ValueError("a template has no words")
        vocabulary = sorted({w for s in said.values() for w in s})
        h = np.array([_text.hash_one(w) for w in vocabulary], np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        number = {vocabulary[o]: i for i, o in enumerate(order.tolist())}
        self.words = {n: [number[w] for w in said[n]] for n in self.names}
        self.counts = {n: np.bincount(self.words[n], minlength=len(order)) for n in self.names}
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, ids: np.ndarray, at: np.ndarray, name: str) -> tuple[float, float, int, int, int]:
        """(coverage, density, matched, first word, last word) of the best place of the template. ids, at: the template words in a text and their places."""
        want = self.words[name]
        length = len(want)
        count = np.bincount(ids, minlength=len(self.hashes))
        distinct = sorted(set(want), key=lambda w: (count[w], w))
        missing = int((1 - self.coverage) * length + 1e-9)
        rare = [w for w in distinct if count[w]][: missing + 1]
        best = (0.0, 0.0, 0, -1, -1)
        reach = 2 * length + 8
        spans = set()
        for w in rare:
            places, offsets = at[ids == w].tolist(), [j for j, x in enumerate(want) if x == w]
            edges = [-1, *places, *[int(at[-1]) + 1] * len(offsets)]
            for i, p in enumerate(places):
                spans.add((p - reach, p + reach + 1))
                # copies close together: from the place before to the one after those of one copy, and the bare length of a copy
                spans.add((max(edges[i] + 1, p - reach), min(edges[i + 1 + len(offsets)], p + reach + 1)))
                spans |= {(p - j - length // 4, p - j + length + length // 4) for j in offsets}
        windows = sorted({(int(np.searchsorted(at, a)), int(np.searchsorted(at, b))) for a, b in spans})
        for lo, hi in windows:
            local = np.minimum(np.bincount(ids[lo:hi], minlength=len(self.hashes)), self.counts[name]).sum()
            if local <= best[2]:
                continue
            got = align(ids[lo:hi].tolist(), want)
            if len(got) <= best[2]:
                continue
            first, last = int(at[lo + got[0][0]]), int(at[lo + got[-1][0]])
            density = len(got) / (last - first + 1)
            if len(got) / length >= self.coverage and density >= self.density:
                best = (len(got) / length, density, len(got), first, last)
        return best

    def scan(self, texts: pa.Array) -> list[tuple[int, list[dict]]]:
        """(words, the templates found) of every text."""
        out: list[tuple[int, list[dict]]] = []
        for _, _, buf, offsets in _text.chunks(texts):
            low = _text.LOWER[buf]
            starts, ends, first = _text.words(buf, offsets, _text.ALNUM)
            h = _text.word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
            maybe = np.flatnonzero(self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
            near = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[near] == h[maybe]
            place, ids = maybe[hit], near[hit]
            rows = len(first) - 1
            cut = np.searchsorted(place, first)
            row = np.repeat(np.arange(rows), np.diff(cut))
            v = len(self.hashes)
            count = np.bincount(row * v + ids, minlength=rows * v).reshape(rows, v)
            found: list[list[dict]] = [[] for _ in range(rows)]
            for name in self.names:
                bound = np.minimum(count, self.counts[name]).sum(axis=1)
                for r in np.flatnonzero(bound >= self.coverage * len(self.words[name]) - 1e-9).tolist():
                    s = slice(cut[r], cut[r + 1])
                    cov, dens, matched, a, b = self.find(ids[s], place[s] - first[r], name)
                    if matched:
                        found[r].append({"license": name, "coverage": cov, "density": dens, "matched": matched, "first_word": a, "last_word": b})
            out += zip(np.diff(first).tolist(), found)
        return out


FOUND = "array<struct<license:string,coverage:double,density:double,matched:int,first_word:int,last_word:int>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, density: float = DENSITY, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words (long), licenses (every template covered, sorted by name) and license, license_coverage (the template of most
    matched words, ties by name; null and 0 where none).

    A template is found where the alignment covers enough of its words, and they make up enough of the words between the first
    and the last match. Null and empty texts have no words and no license. Templates are few and go with the task; texts are taken whole.
    """
    scanner = Scanner(templates or TEMPLATES, coverage, density)

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        got = scanner.scan(_frames.text_column(batch))
        best = [max(f, key=lambda x: (x["matched"], x["coverage"]), default=None) for _, f in got]
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("density", pa.float64()), ("matched", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
        return {
            "n_words": pa.array([n for n, _ in got], pa.int64()),
            "licenses": pa.array([f for _, f in got], kind),
            "license": pa.array([b and b["license"] for b in best], pa.string()),
            "license_coverage": pa.array([b["coverage"] if b else 0.0 for b in best], pa.float64()),
        }

    return _frames.add_columns(docs, [("n_words", "long"), ("licenses", FOUND), ("license", "string"), ("license_coverage", "double")], add, keep)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licence notices in it."""
    return scan_licenses(_frames.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


QUERIES = {"op3_licenses": op3_licenses}
SQL: dict[str, str] = {}
