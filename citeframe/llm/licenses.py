"""License scans by patience alignment.

A text and a license template are aligned on words: words that occur exactly once on both sides are anchors, the longest increasing subsequence of the anchors' places is kept, and the gaps between kept anchors are aligned recursively; equal words at the ends of a gap are matched first, so gaps without anchors still contribute. Coverage is the share of the template's words that are matched.

A notice is a part of the text of at most twice its template's words with a coverage of ``MIN_COVERAGE`` or more. The whole text is searched: a window slides over it, first of five quarters of the template's words and then, in what is left, of twice their number. Where a window holds enough of the template's words, each as often as the template does at most (so no window that could reach the coverage is passed over), it is aligned at the place where it holds most of them. A notice found ends the search of its words, and the search goes on behind it, so notices that stand twice are found twice.

Of notices of one license that overlap the one with more matched words counts. Nulls count as empty texts. Every row gives one row, repeated rows too; without a license its columns are null, its counts 0 and its lists empty; an empty table gives none. The best license is that of the highest coverage; ties go to the longer template, then to the name first in order. Columns other than those named are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_batches, table
from .words import words

MIN_COVERAGE = 0.8
#: License names with notices that put a text under them (fixed values: public license notices).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
]


def increasing(places: list[int]) -> list[int]:
    """Positions of one longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    last: list[int] = []
    back = []
    for i, p in enumerate(places):
        pile = bisect_left(tops, p)
        if pile == len(tops):
            tops.append(p)
            last.append(i)
        else:
            tops[pile], last[pile] = p, i
        back.append(last[pile - 1] if pile else -1)
    out, at = [], last[-1] if last else -1
    while at != -1:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched pairs (place in the text, place in the template), increasing on both sides."""
    out = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        seen, own = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(template[c:d], c) if own[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(text[a:b], a) if w in where and seen[w] == 1]
        kept = [anchors[i] for i in increasing([y for _, y in anchors])]
        if not kept:
            continue
        out += kept
        x, y = a, c
        for i, j in [*kept, (b, d)]:
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
    return sorted(out)


@dataclass
class Scanner:
    templates: list[tuple[str, str]] = field(default_factory=lambda: TEMPLATES)
    least: float = MIN_COVERAGE

    def __post_init__(self):
        self.items = [(name, w, Counter(w)) for name, w in ((name, words(text)) for name, text in self.templates) if w]

    def windows(self, places: list[int], w: list[bytes], own: Counter, need: int, size: int, start: int) -> tuple[int, int] | None:
        """Of the first windows of ``size`` words that hold ``need`` words of a template, the one that holds most; ``places``: where the template's words stand, from ``start`` on."""
        seen: dict[bytes, int] = {}
        held = best = 0
        found, left = None, start
        for right in range(start, len(places)):
            if found and places[right] - places[found[0]] >= size:
                break
            x = w[places[right]]
            seen[x] = seen.get(x, 0) + 1
            held += seen[x] <= own[x]
            while places[right] - places[left] >= size:
                y = w[places[left]]
                held -= seen[y] <= own[y]
                seen[y] -= 1
                left += 1
            if held >= need and held > best:
                best, found = held, (left, right)
        return found

    def notices(self, w: list[bytes], template: list[bytes], own: Counter, lo: int, hi: int, size: int) -> Iterator[tuple[int, int, int]]:
        """(words matched, first word, word after the last) of notices in ``w[lo:hi]``, from left to right."""
        need = ceil(self.least * len(template) - 1e-9)
        places = [i for i in range(lo, hi) if w[i] in own]
        start = 0
        while found := self.windows(places, w, own, need, size, start):
            x, y = places[found[0]], places[found[1]] + 1
            pairs = align(w[x:y], template)
            if len(pairs) >= need:
                yield len(pairs), x + pairs[0][0], x + pairs[-1][0] + 1
                start = bisect_left(places, x + pairs[-1][0] + 1)
            else:
                start = found[0] + 1

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of each notice, best first."""
        w = words(text)
        there = set(w)
        found: dict[str, list[tuple[int, int, int, int]]] = {}
        for name, template, own in self.items:
            n = len(template)
            if sum(own[x] for x in there.intersection(own)) < self.least * n - 1e-9:
                continue
            near = list(self.notices(w, template, own, 0, len(w), n + n // 4 + 2))
            gaps = zip([0, *(b for _, _, b in near)], [*(a for _, a, _ in near), len(w)], strict=True)
            wide = [x for lo, hi in gaps for x in self.notices(w, template, own, lo, hi, 2 * n)]
            found.setdefault(name, []).extend((m, n, a, b) for m, a, b in near + wide)
        out = []
        for name, spans in found.items():
            taken: list[tuple[int, int]] = []
            for m, n, a, b in sorted(spans, key=lambda x: (-x[0], x[1], x[2])):
                k = bisect_left(taken, (a, b))
                if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
                    taken.insert(k, (a, b))
                    out.append((-m / n, -n, name, a, b))
        return [(name, -c, a, b) for c, _, name, a, b in sorted(out)]


def scan_licenses(df: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; license, coverage, first_word and end_word of the best notice; licenses (names, best first) and n_licenses; notices (name:first:end by first word) and n_notices. No shuffle."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanner = scanner or Scanner()
    names = ["doc_id", "license", "coverage", "first_word", "end_word", "licenses", "n_licenses", "notices", "n_notices"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(t or "") for t in batch.column(1).to_pylist()]
            best = [f[0] if f else (None, None, None, None) for f in found]
            arrays = [pa.array([b[k] for b in best], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            kinds = [list(dict.fromkeys(x[0] for x in f)) for f in found]
            spans = [",".join(f"{name}:{a}:{b}" for a, b, name in sorted((a, b, name) for name, _, a, b in f)) for f in found]
            arrays += [pa.array([",".join(k) for k in kinds], pa.string()), pa.array([len(k) for k in kinds], pa.int32()), pa.array(spans, pa.string()), pa.array([len(f) for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, license string, coverage double, first_word int, end_word int, licenses string, n_licenses int, notices string, n_notices int")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
