"""License scan: winnowed template fingerprints pick candidates, banded alignment measures them.

The word k-grams of templates of SHORT words or more are winnowed into an inverted index from fingerprint to
(template, word). A shorter template's fingerprints are single words, so many that any text that holds enough
of the template's words, within the band, holds one of them. A text is scanned once for the index's fingerprints; hits that lie near one
diagonal are one candidate occurrence, and a banded alignment of template and text there gives the share of the
template's words that occur in order, and where. Texts are never shuffled, and one that quotes no template costs
only the scan.

A quote with more words put in than a band is wide is found by chaining the runs of equal words around its hits.

Limit: a quote of a template of SHORT words or more is surely met only if K + WINDOW - 1 of its words stand in
a row as in the template; in a chain, so must words of each part of it.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, chunks_by_size, mix

K, WINDOW = 4, 4
#: Templates of fewer words are met by single words.
SHORT = 40
CHUNK = 1 << 21
#: Bytes of templates that are sent to every task.
MAX_TEMPLATE_BYTES = 16 << 20

#: Bytes that separate words: ASCII other than digits and letters.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Public license notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public "
        "License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return out


def winnow(grams: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the rightmost minimum of each window; of all grams where there are fewer than a window."""
    if len(grams) <= window:
        return list(range(len(grams)))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1)).tolist()


class Index:
    """Inverted index of all templates: for each gram length the sorted fingerprints and where each occurs."""

    def __init__(self, templates: dict[str, str], k: int = K):
        self.names = sorted(templates)
        texts = [WordHashes([templates[n].encode()], _SEPARATOR) for n in self.names]
        self.words = [w.hash for w in texts]
        self.sizes = [(w.byte_end - w.byte_start).tolist() for w in texts]
        found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        self.k = []
        for t, words in enumerate(self.words):
            own = 1 if len(words) < SHORT else k
            self.k.append(own)
            if own == k:
                grams = _grams(words, k)
                for i in winnow(grams):
                    found[k][int(grams[i])].append((t, i))
        self.postings = {own: dict(x) for own, x in found.items()}
        self.sorted = {own: np.array(sorted(x), np.uint64) for own, x in found.items()}
        self.anchors: dict[float, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}

    def anchored(self, coverage: float) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
        """Sorted words and where they stand in short templates: of each the longest, one more than may be missing."""
        if coverage not in self.anchors:
            found: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for t, (words, size) in enumerate(zip(self.words, self.sizes, strict=True)):
                if self.k[t] == 1 and len(words):
                    order = sorted(range(len(words)), key=lambda i: (-size[i], i))
                    for i in order[: len(words) - least_words(len(words), coverage) + 1]:
                        found[int(words[i])].append((t, i))
            self.anchors[coverage] = np.array(sorted(found), np.uint64), dict(found)
        return self.anchors[coverage]


def least_words(n: int, coverage: float) -> int:
    """The fewest of n words, one at least, whose share reaches the coverage."""
    return next((i for i in range(1, n) if i / n >= coverage), n)


def _plausible(places, template: np.ndarray, diagonals: np.ndarray, need: int, band: int) -> np.ndarray:
    """True for diagonals that have `need` of the template's words, repeats counted, within the band around them.

    `places` gives the sorted places of a word.
    """
    lo, hi = diagonals - band, diagonals + len(template) + band
    total = np.zeros(len(diagonals), np.int64)
    for word, n in zip(*np.unique(template, return_counts=True), strict=True):
        at = places(int(word))
        total += np.minimum(np.searchsorted(at, hi) - np.searchsorted(at, lo), n)
    return total >= need


def _anchor_hits(w: WordHashes, index: Index, coverage: float, band: int):
    """(text, short template, place in the text, place in the template) of each word that may begin a find."""
    known, postings = index.anchored(coverage)
    if not len(known) or not len(w.hash):
        return
    slot = np.searchsorted(known, w.hash)
    slot[slot == len(known)] = 0
    at = np.flatnonzero(known[slot] == w.hash)
    if not len(at):
        return
    at = at[np.argsort(slot[at], kind="stable")]
    slots, begin = np.unique(slot[at], return_index=True)
    places = functools.cache(lambda word: np.flatnonzero(w.hash == np.uint64(word)))
    for x, own in zip(slots.tolist(), np.split(at, begin[1:]), strict=True):
        for t, y in postings[int(known[x])]:
            need = least_words(len(index.words[t]), coverage)
            good = own[_plausible(places, index.words[t], own - y, need, band)]
            text = np.searchsorted(w.first, good, side="right") - 1
            for place, d in zip(good.tolist(), text.tolist(), strict=True):
                yield d, t, place - int(w.first[d]), y


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Pairs of equal words in the best alignment whose text place minus template place is within band of diagonal.

    The template is aligned whole to any part of the text; a match counts 3, a gap or mismatch costs 1.
    """
    m, width = len(template), 2 * band + 1
    score = np.zeros((m + 1, width), np.int32)
    move = np.zeros((m + 1, width), np.int8)
    places = np.arange(width) - band + diagonal
    for i in range(1, m + 1):
        at = places + i - 1
        inside = (at >= 0) & (at < len(text))
        equal = np.zeros(width, bool)
        equal[inside] = text[at[inside]] == template[i - 1]
        diag = score[i - 1] + np.where(equal, 3, -1)
        skip = np.concatenate((score[i - 1][1:], [-(1 << 20)])) - 1  # the template's word is missing
        row = np.maximum(diag, skip)
        # words of the text that are not in the template: best of row[x] - (y - x) over x < y
        reach = np.maximum.accumulate(row + np.arange(width)) - np.arange(width)
        score[i] = np.maximum(row, reach)
        move[i] = np.where(reach > row, 2, np.where(skip > diag, 1, 0))
    i, y = m, int(score[m].argmax())
    pairs = []
    while i > 0:
        if move[i, y] == 2:
            y -= 1
        elif move[i, y] == 1:
            i, y = i - 1, y + 1
        else:
            at = y - band + diagonal + i - 1
            if 0 <= at < len(text) and text[at] == template[i - 1]:
                pairs.append((i - 1, at))
            i -= 1
    return pairs[::-1]


def scan(texts: list[bytes], index: Index, coverage: float = 0.8, band: int = 12) -> list[list[dict]]:
    """For each text the occurrences of templates: name, share of its words found, byte span."""
    out: list[list[dict]] = []
    for i, j in chunks_by_size(texts, CHUNK):
        w = WordHashes(texts[i:j], _SEPARATOR)
        hits: dict[tuple[int, int], list] = defaultdict(list)
        for k, known in index.sorted.items():
            grams = _grams(w.hash, k)
            if not len(grams):
                continue
            slot = np.searchsorted(known, grams)
            slot[slot == len(known)] = 0
            at = np.flatnonzero(known[slot] == grams)
            doc = np.searchsorted(w.first, at, side="right") - 1
            whole = at + k <= w.first[doc + 1]
            for place, d in zip(at[whole].tolist(), doc[whole].tolist(), strict=True):
                for t, word in index.postings[k][int(grams[place])]:
                    hits[d, t].append((place - int(w.first[d]), word))
        for d, t, place, word in _anchor_hits(w, index, coverage, band):
            hits[d, t].append((place, word))
        found: list[list[dict]] = [[] for _ in range(j - i)]
        for (d, t), pairs in sorted(hits.items()):
            words, template = w.hash[w.first[d] : w.first[d + 1]], index.words[t]
            found[d] += _occurrences(words, template, pairs, index.names[t], coverage, band, index.k[t])
        for d, matches in enumerate(found):
            base, begin = int(w.text_start[d]), int(w.first[d])
            for m in matches:
                first, last = m.pop("words")
                m["start"], m["end"] = int(w.byte_start[begin + first]) - base, int(w.byte_end[begin + last]) - base
            out.append(sorted(matches, key=lambda m: (m["start"], m["end"], m["license"])))
    return out


def _verbatim(words: np.ndarray, template: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int]]:
    """First and last word of the disjoint places, from the left, where all of the template stands word for word."""
    at = diagonals[(diagonals >= 0) & (diagonals + len(template) <= len(words))]
    for j, word in enumerate(template):
        at = at[words[at + j] == word]
    found: list[tuple[int, int]] = []
    for x in at.tolist():
        if not found or x > found[-1][1]:
            found.append((x, x + len(template) - 1))
    return found


def _runs(words: np.ndarray, template: np.ndarray, pairs: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(place in the text, place in the template, length) of the longest runs of equal words around the hits between lo and hi."""
    runs, reached = [], {}
    for place, word in pairs:
        diagonal = place - word
        if place < reached.get(diagonal, lo):
            continue
        a, b = place, place
        while a > lo and a > diagonal and words[a - 1] == template[a - 1 - diagonal]:
            a -= 1
        while b < hi and b - diagonal < len(template) and words[b] == template[b - diagonal]:
            b += 1
        reached[diagonal] = max(b, place + 1)
        if b > a:
            runs.append((a, a - diagonal, b - a))
    return sorted(runs)


def _chained(words, template, pairs, lo, hi, band) -> tuple[int, int, int] | None:
    """(first word, last word, words found) of the best chain of runs, in order in text and template, with any words
    of at most the template's length, in all, put in between; what stands between near runs is aligned."""
    runs = _runs(words, template, pairs, lo, hi)
    best: list[tuple[int, int]] = []  # words of the best chain that ends with each run, and the run before
    for i, (x, t, n) in enumerate(runs):
        top = (n, -1)
        for j in range(i - 1, -1, -1):
            u, s, m = runs[j]
            if x - u > 2 * len(template):
                break
            over = max(0, u + m - x, s + m - t)
            if u < x and s < t and over < n and best[j][0] + n - over > top[0]:
                top = (best[j][0] + n - over, j)
        best.append(top)
    if not best:
        return None
    i = max(range(len(best)), key=lambda i: (best[i][0], -i))
    chain = []
    while i >= 0:
        chain.append(runs[i])
        i = best[i][1]
    chain.reverse()
    found, (end_x, end_t) = 0, (chain[0][0], chain[0][1])
    for x, t, n in chain:
        if x > end_x and t > end_t and x - end_x <= t - end_t + band:
            found += len(align(template[end_t:t], words[end_x:x], 0, band))
        over = max(0, end_x - x, end_t - t)
        found += n - over
        end_x, end_t = x + n, t + n
    return chain[0][0], end_x - 1, found


def _occurrences(words, template, pairs, name, coverage, band, k):
    """Align the template along every group of hits whose diagonals lie together; overlapping finds are one.

    The text between finds is searched again until no alignment in it reaches the coverage, so disjoint finds are
    all kept, however close they stand.
    """
    pairs = sorted(pairs)
    places = [place for place, _ in pairs]
    found, parts = [], [(0, len(words))]

    def accept(lo, hi, finds):
        """Keep finds, and search what they leave of the part."""
        spans = sorted(f["words"] for f in finds)
        found.extend(finds)
        parts.extend(zip([lo, *(b + 1 for _, b in spans)], [*(a for a, _ in spans), hi], strict=True))

    whole = _verbatim(words, template, np.unique([place - word for place, word in pairs]))
    if whole:
        parts.clear()
        accept(0, len(words), [{"license": name, "coverage": 1.0, "words": x} for x in whole])
    while parts:
        lo, hi = parts.pop()
        if (hi - lo) / len(template) < coverage:
            continue
        groups: list[list[int]] = []
        for diagonal in sorted(x - y for x, y in pairs[bisect_left(places, lo - k + 1) : bisect_left(places, hi)]):
            if groups and diagonal - groups[-1][0] <= band:
                groups[-1].append(diagonal)
            else:
                groups.append([diagonal])
        reached = []
        for g in groups:
            matched = align(template, words[lo:hi], (g[0] + g[-1]) // 2 - lo, band + (g[-1] - g[0] + 1) // 2)
            share = len(matched) / len(template)
            if matched and share >= coverage:
                reached.append({"license": name, "coverage": share, "words": (matched[0][1] + lo, matched[-1][1] + lo)})
        best: list[tuple[int, int]] = []
        finds = []
        for f in sorted(reached, key=lambda f: (-f["coverage"], f["words"])):
            x = bisect_left(best, f["words"])
            if (x == 0 or best[x - 1][1] < f["words"][0]) and (x == len(best) or f["words"][1] < best[x][0]):
                best.insert(x, f["words"])
                finds.append(f)
        if not finds and k > 1:
            # words that were put in may have moved the rest out of every band
            inside = pairs[bisect_left(places, lo) : bisect_left(places, hi)]
            chain = _chained(words, template, [(x, y) for x, y in inside if x + k <= hi], lo, hi, band)
            if chain and chain[2] / len(template) >= coverage:
                finds = [{"license": name, "coverage": chain[2] / len(template), "words": chain[:2]}]
        if finds:
            accept(lo, hi, finds)
    return found


def license_matches(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    coverage: float = 0.8,
    band: int = 12,
) -> DataFrame:
    """One row (id, n_matches, licenses, matches) for each row of docs.

    `matches` holds each occurrence in order of its place: license, coverage (share of the template's words
    found in order), start and end in characters; `licenses` their sorted distinct names. Null and empty
    texts match nothing; repeats are treated one by one; a template without words matches nothing; other
    columns are ignored. Two templates may match at one place; one template's overlapping finds are one,
    that of most coverage. Finds that share no word are all kept.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates are over {MAX_TEMPLATE_BYTES} bytes; scan with parts of them and unite the results")
    item = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        index = Index(templates)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            found = scan(texts, index, coverage, band)
            for text, matches in zip(texts, found, strict=True):
                places, at, chars = {}, 0, 0
                for place in sorted({m[x] for m in matches for x in ("start", "end")}):  # one pass over the text, whatever its matches
                    chars += len(text[at:place].decode("utf-8", "replace"))
                    places[place], at = chars, place
                for m in matches:
                    m["start"], m["end"] = places[m["start"]], places[m["end"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([sorted({m["license"] for m in f}) for f in found], pa.list_(pa.string())),
                    pa.array(found, pa.list_(item)),
                ],
                ["id", "n_matches", "licenses", "matches"],
            )

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary"))
    schema = (
        f"id {docs.schema[id_col].dataType.simpleString()}, n_matches long, licenses array<string>, "
        "matches array<struct<license: string, coverage: double, start: long, end: long>>"
    )
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)
