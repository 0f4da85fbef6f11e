"""License scans by patience alignment.

A text and a license template are aligned on the words that are unique to both: the longest increasing subsequence of
their places gives anchors, and the gaps between anchors are aligned the same way again. The share of template words
that are aligned is the coverage; a passage with enough coverage is a find.

Templates are a bounded parameter (``MAX_TEMPLATE_WORDS``); texts stream through tasks, whole and one at a time, with no
shuffle. In a long text the alignment runs on passages: places where enough of a template's own words (not
function words) stand near each other. Where a passage holds a notice several times, copies are placed by the votes of all
own words, and what no find covers is aligned again.

Defined cases: null, empty and wordless texts have no finds; equal templates give the same finds under each name;
repeated rows keep their own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.llm.common import WORD_BYTES, text_bytes

MAX_TEMPLATE_WORDS = 1_000_000

# Notices as their licenses recommend them, by license identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
]
# Words that say nothing about a license.
FUNCTION_WORDS = frozenset(b"a an and any are as at be by for from if in is it not of on or that the this to under was with you".split())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def increasing(places: Sequence[int]) -> list[int]:
    """Indexes of a longest increasing subsequence of different numbers, by patience piles."""
    tops: list[int] = []
    owners: list[int] = []
    before: list[int] = []
    for k, x in enumerate(places):
        pile = bisect_left(tops, x)
        before.append(owners[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(x)
            owners.append(k)
        else:
            tops[pile], owners[pile] = x, k
    out, k = [], owners[-1] if owners else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned places (i in a, j in b), increasing in both."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, ii, j, jj = open_.pop()
        while i < ii and j < jj and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ii and j < jj and a[ii - 1] == b[jj - 1]:
            ii, jj = ii - 1, jj - 1
            out.append((ii, jj))
        if i == ii or j == jj:
            continue
        in_a, in_b = Counter(a[i:ii]), Counter(b[j:jj])
        where = {w: k for k, w in enumerate(b[j:jj], j) if in_b[w] == 1}
        common = [(k, where[w]) for k, w in enumerate(a[i:ii], i) if in_a[w] == 1 and w in where]
        anchors = [common[k] for k in increasing([q for _, q in common])]
        if not anchors:
            continue
        out += anchors
        for (p, q), (pp, qq) in zip([(i - 1, j - 1), *anchors], [*anchors, (ii, jj)], strict=True):
            open_.append((p + 1, pp, q + 1, qq))
    return sorted(out)


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], min_coverage: float, slack: int) -> None:
        self.templates = [(name, own) for name, text in templates if (own := words_of(text.encode()))]
        if sum(len(own) for _, own in self.templates) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have over {MAX_TEMPLATE_WORDS} words; give them in several scans")
        self.min_coverage, self.slack = min_coverage, slack
        self.keys: dict[bytes, list[int]] = {}
        #: for each template: own words with their places, and how many of them a passage needs at least
        self.need, self.places = [], []
        for k, (_, own) in enumerate(self.templates):
            keys = [w for w in own if w not in FUNCTION_WORDS] or own
            self.places.append({w: [q for q, x in enumerate(own) if x == w] for w in keys})
            self.need.append(max(1, ceil(min_coverage * len(own)) - (len(own) - len(keys))))
            for w in set(keys):
                self.keys.setdefault(w, []).append(k)
        self.key_set = frozenset(self.keys)

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int, int, float]]]:
        """Number of words, and finds (license, begin word, end word, coverage)."""
        words = words_of(text)
        if self.key_set.isdisjoint(words):
            return len(words), []
        by_template: dict[int, list[int]] = {}
        for p, w in enumerate(words):
            if w in self.key_set:
                for k in self.keys[w]:
                    by_template.setdefault(k, []).append(p)
        finds = []
        for k, hits in sorted(by_template.items()):
            if len(hits) >= self.need[k]:
                finds += self._of_template(k, hits, words)
        best: dict[tuple[str, int, int], float] = {}
        for name, begin, end, coverage in finds:
            best[name, begin, end] = max(best.get((name, begin, end), 0), coverage)
        return len(words), sorted((*key, coverage) for key, coverage in best.items())

    def _of_template(self, k: int, hits: list[int], words: list[bytes]) -> list[tuple[str, int, int, float]]:
        own, reach = self.templates[k][1], len(self.templates[k][1]) + self.slack
        clusters, begin = [], 0
        for at in range(1, len(hits) + 1):
            if at == len(hits) or hits[at] - hits[at - 1] > reach:
                clusters.append(hits[begin:at])
                begin = at
        out: list[tuple[str, int, int, float]] = []
        for cluster in clusters:
            if len(cluster) < self.need[k]:
                continue
            free = [(max(cluster[0] - reach, 0), min(cluster[-1] + 1 + reach, len(words)))]
            if min(Counter(words[p] for p in cluster).values()) == 1:  # often one copy only
                self._claim(k, words, free, *free[0], out)
            for start in self._starts(k, cluster, words):
                self._claim(k, words, free, start - self.slack, start + reach, out)
            while any(self._claim(k, words, free, *gap, out) for gap in sorted(free)):
                pass
        return out

    def _starts(self, k: int, cluster: list[int], words: list[bytes]) -> list[int]:
        """Where copies may begin: each own word votes for its distance from the template's begin; most votes first."""
        step = self.slack + 1
        votes = Counter((p - q) // step for p in cluster for q in self.places[k][words[p]])
        near = {b: n + votes[b - 1] + votes[b + 1] for b, n in list(votes.items())}
        return [b * step for b in sorted(near, key=lambda b: (-near[b], b)) if near[b] >= max(1, self.need[k] // 4)]

    def _claim(self, k: int, words: list[bytes], free: list[tuple[int, int]], low: int, high: int, out: list[tuple[str, int, int, float]]) -> bool:
        """Aligns what is free from low to high; a find's words are then no longer free."""
        name, own = self.templates[k]
        least = self.min_coverage * len(own)
        for a, b in free:
            begin, end = max(a, low), min(b, high)
            if end - begin < least:
                continue
            aligned = self._densest(patience(words[begin:end], own))
            if len(aligned) >= least:
                first, last = begin + aligned[0][0], begin + aligned[-1][0] + 1
                out.append((name, first, last, len(aligned) / len(own)))
                free.remove((a, b))
                free += [(a, first), (last, b)]
                return True
        return False

    def _densest(self, aligned: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The largest run of aligned words without a gap in the text of more than ``slack`` over that in the template."""
        breaks = [k for k in range(1, len(aligned)) if aligned[k][0] - aligned[k - 1][0] - (aligned[k][1] - aligned[k - 1][1]) > self.slack]
        runs = [aligned[a:b] for a, b in zip([0, *breaks], [*breaks, len(aligned)], strict=True)]
        return max(runs, key=len, default=[])


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    *,
    min_coverage: float = 0.8,
    slack: int = 4,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """id, n_words, finds: array of (license, begin, end, coverage), places in words."""
    scanner = Scanner(templates, min_coverage, slack)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, finds = [], []
            for text in text_bytes(batch.column(1)):
                n, own = scanner.scan(text)
                counts.append(n)
                finds.append([dict(zip(("license", "begin", "end", "coverage"), f, strict=True)) for f in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(finds, kind)], names=[id_column, "n_words", "finds"])

    kind = pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
    found = T.StructType([T.StructField("license", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("coverage", T.DoubleType())])
    schema = T.StructType([docs.schema[id_column], T.StructField("n_words", T.LongType()), T.StructField("finds", T.ArrayType(found))])
    return docs.select(id_column, text_column).mapInArrow(scan, schema)


def licenses(finds: Column) -> Column:
    """Sorted different licenses of a ``finds`` column."""
    return F.array_sort(F.array_distinct(F.transform(finds, lambda x: x["license"])))
