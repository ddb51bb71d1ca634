"""License scans: winnowed fingerprints find candidates, banded alignment reports matches.

Templates and texts are lower-case words; a number with points is one word, without closing zeros, and "v" before a number, also
in "GPLv3", is the word "version". Hashes of k-grams
are winnowed: of each few
neighbours the smallest is kept, so a run of k + window - 1 words that a text shares with
a template shares a fingerprint. The templates' fingerprints make an inverted index, as
small as the given list of templates, which goes to all tasks with the code. Hits of a
template on nearby diagonals make a candidate; the template is aligned with the words
around it inside a band. A matched word gains two points and a word of the text that is skipped between
matched ones costs one, so the alignment gives the matched words and a tight span.

The coverage of a match is its matched words by the words of the template or of the span, whichever are more. Licenses of
one family differ in a few words only. So a match with a template of a family counts only if its span has the same
qualifying words where the family has them: "affero", "lesser" or "library" between "GNU" and "Public License", "NC" and the
like anywhere in a line about Creative Commons. What other licenses say about libraries is no concern of theirs. Where the template
has numbers, the span must have the same ones, and a statement of a few words must have all of them that name the license.
Of overlapping spans the one with the most matched words is reported; of equal ones that with the better coverage.

A statement of up to SHORT words is found if K words in a row of it are there, a longer one if K + WINDOW - 1 are, as
in every match of it.

Everything is a projection of each row. Defined results: a null text counts as
empty; a text without a match gives no spans. Repeated rows are scanned one by one; other columns have no part in it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brainstate.llm.common import slices

K = 3
WINDOW = 2
#: Words of a template that isn't winnowed.
SHORT = 8
MIN_COVERAGE = 0.8
#: Words that an alignment may be off its diagonal, at least and as a share of the template.
BAND = 3
BAND_SHARE = 0.1

#: Words that tell licenses of one family apart, by the beginning of their names.
GNU_QUALIFIERS = frozenset("affero lesser library".split())
CC_QUALIFIERS = frozenset("nc nd sa non noncommercial noderivatives noderivs sharealike zero cc0".split())
#: Words of short statements that don't name a license.
COMMON = frozenset("a an distributed general identifier is license licensed of public released software spdx the this under version work".split())
GNU_NAMES = ("GPL", "LGPL", "AGPL")

#: Short statements and notices of public licenses; {} stands for what a family's members differ in.
MIT_NOTICE = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
    "OF ANY KIND, either express or implied."
)
BSD_2_NOTICE = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
BSD_3_CLAUSE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
BSD_4_CLAUSE = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization."
)
ISC_NOTICE = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
UNLICENSE_NOTICE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software."
)
BOOST_NOTICE = "Distributed under the Boost Software License, Version 1.0."
ECLIPSE_NOTICE = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
    "which is available at https://www.eclipse.org/legal/epl-2.0/"
)
ZLIB_NOTICE = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
    "software for any purpose, including commercial applications, and to alter it and redistribute it freely"
)
CC0_NOTICE = "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"
GNU_SHORT = "This work is licensed under the GNU {} Public License, version {}."
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} "
    "Public License as published by the Free Software Foundation, either version {} of the License, or (at your "
    "option) any later version."
)
GNU_BARE = "GNU {} Public License version {}"
GNU_ABBREVIATED = ("Licensed under the {} version {}", "Licensed under {} version {}", "SPDX-License-Identifier: {} {}")
CC_SHORT = "Licensed under CC {} {}."
CC_NOTICE = "This work is licensed under the Creative Commons {} {} {} License."
GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
CC = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = {"3.0": "Unported", "4.0": "International"}

TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_NOTICE),
    ("BSD-2-Clause", BSD_2_NOTICE),
    ("BSD-3-Clause", f"{BSD_2_NOTICE} {BSD_3_CLAUSE}"),
    ("BSD-4-Clause", f"{BSD_2_NOTICE} {BSD_4_CLAUSE} {BSD_3_CLAUSE}"),
    ("ISC", ISC_NOTICE),
    ("MPL-2.0", MPL_NOTICE),
    ("Unlicense", UNLICENSE_NOTICE),
    ("BSL-1.0", BOOST_NOTICE),
    ("EPL-2.0", ECLIPSE_NOTICE),
    ("Zlib", ZLIB_NOTICE),
    ("CC0-1.0", CC0_NOTICE),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *(
        (f"{k}-{v}" if "." in v else f"{k}-{v}.0", form.format(GNU[k], v))
        for k, versions in GNU_VERSIONS.items()
        for v in versions
        for form in (GNU_SHORT, GNU_NOTICE, GNU_BARE)
    ),
    *(
        (f"{k}-{v}" if "." in v else f"{k}-{v}.0", form.format(k, v))
        for k, versions in GNU_VERSIONS.items()
        for v in versions
        for form in GNU_ABBREVIATED
    ),
    *((f"CC-{kind}-{v}", CC_SHORT.format(kind, v)) for kind in CC_KINDS for v in CC_VERSIONS),
    *(
        (f"CC-{kind}-{v}", CC_NOTICE.format("-".join(CC[k] for k in kind.split("-")), v, place))
        for kind in CC_KINDS
        for v, place in CC_VERSIONS.items()
    ),
)

_WORD = re.compile(r"\b[al]?gpl(?=v?\d)|(?:(?<=\b)|(?<=gpl))v(?=\d)|\d+(?:\.\d+)+|\w+", re.I)
_ZEROS = re.compile(r"(?:\.0+)+$")
_CACHE = 400_000
_hashes: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_hashes) > _CACHE:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def words_of(lowered: str) -> list[str]:
    """Words of a lower-case text; 2.0 is 2, and v is version."""
    return [_ZEROS.sub("", w) if "." in w else "version" if w == "v" else w for w in _WORD.findall(lowered)]


def told_apart(name: str, words: list[str]) -> tuple[set[str], set[str]]:
    """Among words, the qualifying ones of the family that a license's name belongs to, and the numbers."""
    numbers = {w for w in words if w[0].isdecimal() and w.replace(".", "").isdecimal()}
    if name.startswith("CC"):
        return CC_QUALIFIERS.intersection(words), numbers
    marks: set[str] = set()
    if name.startswith(GNU_NAMES):
        after = 4  # words since the last "gnu"; a license's name has no more than three up to "public"
        for w in words:
            after = 0 if w == "gnu" else after + 1
            if after < 4 and w in GNU_QUALIFIERS:
                marks.add(w)
    return marks, numbers


def grams(hashes: np.ndarray, k: int = K) -> np.ndarray:
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnowed(gram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest of each `window` neighbours, the rightmost of equals; all, if they are fewer."""
    n = len(gram) - window + 1
    if n <= 0:
        return np.arange(len(gram))
    best = np.full(n, window - 1)
    least = gram[window - 1 : window - 1 + n].copy()
    for j in range(window - 2, -1, -1):
        smaller = gram[j : j + n] < least
        best[smaller] = j
        least = np.where(smaller, gram[j : j + n], least)
    return np.unique(best + np.arange(n))


class Index:
    """Fingerprint to (template, place), and the templates' words."""

    def __init__(self, templates):
        self.names = [name for name, _ in templates]
        words = [words_of(text.lower()) for _, text in templates]
        self.marks = [told_apart(name, w) for name, w in zip(self.names, words, strict=True)]
        self.places: dict[int, list[tuple[int, int]]] = {}
        # One other word in a short statement names another license.
        self.needed = [set(w) - COMMON if len(w) <= SHORT else set() for w in words]
        self.words = [word_hashes(w) for w in words]
        short: set[int] = set()
        for t, words in enumerate(self.words):
            gram = grams(words)
            # Of a short template every k-gram counts: it has few neighbours to be found by.
            all_of = len(words) <= SHORT
            short.update(gram.tolist() if all_of else ())
            for p in range(len(gram)) if all_of else winnowed(gram).tolist():
                self.places.setdefault(int(gram[p]), []).append((t, p))
        self.keys = np.array(sorted(self.places), np.uint64)
        self.short = np.array([k in short for k in self.keys.tolist()], bool)


    def agrees(self, t: int, span: list[str]) -> bool:
        """Whether a span has the words that tell a template from others."""
        marks, numbers = told_apart(self.names[t], span)
        own, own_numbers = self.marks[t]
        return marks == own and (numbers == own_numbers or not own_numbers) and self.needed[t] <= set(span)


def align(template: np.ndarray, words: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """Matched words, first and last place in words of the best alignment near diagonal `start`.

    The template is aligned with any part of words whose places lie within `band` of
    start + i for its word i. A match gains 2, a word skipped between matches costs 1; words of the template that are
    skipped cost nothing but their matches. Of equal ones, the last start and then the first end is best.
    """
    own, others = template.tolist(), words.tolist()
    low, width = start - band, 2 * band + 1
    none = (0, 0, 0)
    found = (0, 0, 0, 0)  # gain, first and minus the last matched place, matches
    best = [none] * (width + 1)  # per diagonal: gain, first matched place, matches
    for i, word in enumerate(own):
        row: list[tuple[int, int, int]] = []
        left = none
        for d in range(width):
            j = low + i + d
            here = max((left[0] - 1, left[1], left[2]) if left[2] else none, best[d + 1], none)
            if 0 <= j < len(others) and others[j] == word:
                gain, first, m = best[d]
                mine = (gain + 2, first if m else j, m + 1)
                here = max(here, mine)
                found = max(found, (mine[0], mine[1], -j, mine[2]))
            row.append(here)
            left = here
        best = [*row, none]
    return found[3], found[1], -found[2]


def scan(text: str, index: Index, least: float = MIN_COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, start, end) of the matches in a text, by place; places are code points."""
    lowered = text.lower()
    names = words_of(lowered)
    words = word_hashes(names)
    gram = grams(words)
    if not len(gram):
        return []
    at = np.minimum(np.searchsorted(index.keys, gram), len(index.keys) - 1)
    hit = index.keys[at] == gram
    if not hit.any():
        return []
    kept = np.zeros(len(gram), bool)
    kept[winnowed(gram)] = True
    candidates: dict[int, list[tuple[int, int]]] = {}
    for p in np.flatnonzero(hit & (kept | index.short[at])).tolist():
        for t, q in index.places[int(gram[p])]:
            candidates.setdefault(t, []).append((p - q, p))
    found = []
    known: dict[tuple[int, int, int, bytes], tuple[int, int, int]] = {}

    def aligned(t: int, start: int, band: int) -> tuple[int, int, int]:
        """align(), once for each template and surroundings: repeated lines have the same ones."""
        low = start - band
        begin = max(low, 0)
        near = words[begin : max(low + len(index.words[t]) + 2 * band, 0)]
        key = (t, band, begin - low, near.tobytes())
        if key not in known:
            known[key] = align(index.words[t], near, start - begin, band)
        m, first, last = known[key]
        return m, first + begin, last + begin

    def covered(t: int, match: tuple[int, int, int]) -> float:
        """Coverage of a match; 0 if its span has other qualifying words or numbers than the template."""
        m, first, last = match
        n = len(index.words[t])
        if m < least * n or m < least * (last - first + 1):
            return 0.0
        return m / max(n, last - first + 1) if index.agrees(t, names[first : last + 1]) else 0.0

    for t, diagonals in candidates.items():
        template = index.words[t]
        band = max(BAND, int(BAND_SHARE * len(template)))
        reach, hopeful, tried = None, False, None
        wide: list[tuple[int, int, int]] = []
        own: list[tuple[int, int, int]] = []  # (first, last, matches), sorted
        longest = 0

        def inside(a: int, b: int, own=own) -> int:
            """How many of own have a place from a to b; longest bounds where they begin."""
            return sum(last >= a for _, last, _ in own[bisect_left(own, (a - longest,)) : bisect_left(own, (b + 1,))])  # noqa: B023

        for start, p in sorted(set(diagonals)):
            if reach is None or start > reach:
                reach = start + 2 * band
                match = aligned(t, start + band, 2 * band)
                hopeful = match[0] >= least * len(template)
                if hopeful:
                    wide.append(match)
            # The wide band may hold several occurrences: each diagonal outside the matched ones is aligned by itself.
            if not hopeful or start == tried or inside(p, p):
                continue
            tried = start
            m, first, last = aligned(t, start, band)
            if m >= least * len(template):
                insort(own, (first, last, m))
                longest = max(longest, last - first)
        wide = [x for x in wide if inside(x[1], x[2]) < 2]
        matches = {*wide, *((m, first, last) for first, last, m in own)}
        found += [(x[0], c, index.names[t], x[1], x[2]) for x in matches if (c := covered(t, x))]
    if not found:
        return []
    spans = [x.span() for x in _WORD.finditer(text)] if len(lowered) == len(text) else [x.span() for x in _WORD.finditer(lowered)]
    out: list[tuple[str, float, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for m, coverage, name, first, last in sorted(found, key=lambda x: (-x[0], -x[1], x[4] - x[3], x[3], x[2])):
        at = bisect_left(taken, (first, last))  # those that are taken don't overlap: only the neighbours can
        if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
            taken.insert(at, (first, last))
            out.append((name, coverage, m, spans[first][0], spans[last][1]))
    return sorted(out, key=lambda x: x[3])


_SPANS = "array<struct<license:string,coverage:double,matched:long,start:long,end:long>>"
_SPAN = pa.struct(
    [("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
)


def with_licenses(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> DataFrame:
    """(doc_id, licenses) of docs: the matched templates of each text with coverage and span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        names = [f.name for f in _SPAN]
        for batch in slices(batches, 1):
            rows = [[dict(zip(names, x, strict=True)) for x in scan(t or "", index)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "licenses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text}`")).mapInArrow(run, f"doc_id {kind}, licenses {_SPANS}")
