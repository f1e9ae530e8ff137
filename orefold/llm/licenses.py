"""License scans by winnowed fingerprints, chained pieces and banded alignment (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.llm.common import run_hashes, word_hashes, words_of

#: Words of a fingerprint's run, in templates of SHORT words or more and in shorter ones, and runs of a window. Of each window of a template its least run
#: is kept, so WINDOW + RUN - 1 equal words always hold a fingerprint; in shorter templates every run is one.
RUN, SHORT_RUN, SHORT, WINDOW = 3, 2, 20, 4
#: Least share of a template's words that a match covers; greatest half width of the alignment's band, in words (an eighth of a shorter template).
COVERAGE, BAND = 0.75, 12
#: Words that may stand between two pieces of one match: so many times the template's length, and in short templates once, or so many words.
REACH, SHORT_REACH = 8, 8

# Notices and texts of public licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions
in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def winnow(runs: np.ndarray, window: int) -> np.ndarray:
    """Where the least of each ``window`` consecutive runs stands, the last of equal ones; each place once. Fewer runs are one window."""
    if not len(runs):
        return np.empty(0, np.int64)
    window = min(window, len(runs))
    views = np.lib.stride_tricks.sliding_window_view(runs, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


@lru_cache(maxsize=4)
def index(templates: tuple[tuple[str, str], ...]) -> tuple[list[str], list[np.ndarray], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Names, words, and the inverted index of each length of run: fingerprints in order, with the template and the place of each."""
    names, words, rows = [], [], {}
    for i, (name, text) in enumerate(templates):
        h = words_of(np.frombuffer(text.encode(), dtype=np.uint8), np.empty(0, np.int64), _GAP)[0]
        names.append(name)
        words.append(h)
        k = min(RUN if len(h) >= SHORT else SHORT_RUN, len(h))
        if k:
            runs = run_hashes(h, k)
            rows.setdefault(k, []).extend((runs[p], i, int(p)) for p in (winnow(runs, WINDOW) if len(h) >= SHORT else range(len(runs))))
    for k in rows:
        rows[k].sort(key=lambda r: (int(r[0]), r[1], r[2]))
    return names, words, {k: (np.array([r[0] for r in x], dtype=np.uint64), np.array([r[1] for r in x]), np.array([r[2] for r in x])) for k, x in rows.items()}


def align(text: np.ndarray, template: np.ndarray, offset: int, band: int = BAND) -> list[tuple[int, int]]:
    """Matched (word of the text, word of the template) pairs of a longest common subsequence near one diagonal.

    Word i of the template may match words i + offset - band to i + offset + band of the text.
    """
    n, width = len(template), 2 * band + 1
    best = np.zeros((n + 1, width + 1), dtype=np.int32)  # row i, diagonal d: the text up to word i + offset - band + d
    step = np.zeros((n + 1, width), dtype=np.int8)
    for i in range(1, n + 1):
        j = i - 1 + offset - band + np.arange(width)
        ok = (j >= 0) & (j < len(text))
        hit = np.zeros(width, dtype=bool)
        hit[ok] = text[j[ok]] == template[i - 1]
        take, skip = best[i - 1, :width] + hit, best[i - 1, 1:]  # one template word more without a text word: diagonal d + 1 above
        row = np.maximum(take, skip)
        left = np.maximum.accumulate(row)
        step[i] = np.where(left > row, 2, np.where(hit & (take >= skip), 1, np.where(skip >= take, 3, 0)))
        best[i, :width] = left
        best[i, width] = 0
    i, d, out = n, width - 1, []
    while i > 0 and d >= 0:
        s = step[i, d] if d < width else 3
        if s == 2:
            d -= 1
        elif s == 1:
            out.append((i - 1 + offset - band + d, i - 1))
            i -= 1
        elif s == 3:
            i, d = i - 1, d + 1
            if d >= width:
                d = width - 1
        else:
            i -= 1
    return out[::-1]


def pieces(h: np.ndarray, k: int, keys: np.ndarray, owner: np.ndarray, place: np.ndarray, words: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each template, (word of the text, word of the template, words) of the longest equal pieces around its fingerprints in the text, in order."""
    runs = run_hashes(h, k)
    lo, hi = np.searchsorted(keys, runs, side="left"), np.searchsorted(keys, runs, side="right")
    at = np.flatnonzero(hi > lo)
    n = hi[at] - lo[at]
    entry = np.repeat(lo[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    p, t, q = np.repeat(at, n), owner[entry], place[entry]
    order = np.lexsort((q, p - q, t))
    p, t, q = p[order], t[order], q[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (np.diff(p - q) != 0)][: len(p)])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(starts, np.r_[starts[1:], len(p)]):  # a template on one diagonal
        shift, mine = int(p[a] - q[a]), words[t[a]]
        first = max(0, -shift)
        equal = h[first + shift: len(mine) + shift] == mine[first: max(first, min(len(mine), len(h) - shift))]
        edges = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8))) + first
        which = np.unique(np.searchsorted(edges[::2], q[a:b], side="right") - 1)
        found.setdefault(int(t[a]), []).extend((int(edges[2 * i]) + shift, int(edges[2 * i]), int(edges[2 * i + 1] - edges[2 * i])) for i in which)
    return {x: np.array(sorted(rows)) for x, rows in found.items()}


def chains(piece: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the best chain that ends with each piece (less a part of a word for gaps, so near pieces go first), and the piece before it (or -1).

    Pieces follow each other in text and template, at most ``reach`` words of the text apart; where two overlap, the later one is cut.
    """
    p, q, n = piece.T
    score, before = n.astype(float), np.full(len(p), -1)
    low = np.searchsorted(p, p - reach - size)
    for i in range(1, len(p)):
        j = slice(low[i], i)
        gap = p[i] - p[j] - n[j]
        over = np.maximum(0, np.maximum(-gap, q[j] + n[j] - q[i]))
        value = score[j] + n[i] - over - np.maximum(0, gap) / (4 * reach * size)
        value[(over >= n[i]) | (q[j] >= q[i]) | (p[j] >= p[i]) | (gap > reach)] = 0
        if len(value) and value.max() > score[i]:
            before[i] = low[i] + len(value) - 1 - value[::-1].argmax()
            score[i] = value.max()
    return score, before


def fill(h: np.ndarray, template: np.ndarray, chain: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Matched pairs of a chain: its pieces, and what aligns between them and, near their diagonals, before the first and after the last."""
    pairs: list[tuple[int, int]] = []
    end_p, end_q = 0, 0
    for n, (p, q, size) in enumerate([*chain.tolist(), [len(h), len(template), 0]]):
        last = n == len(chain)
        cut = max(0, end_p - p, end_q - q) if n and not last else 0
        p, q, size = p + cut, q + cut, size - cut
        gap = q - end_q
        if gap > 0:
            side = gap + band
            if not n:
                at = np.arange(max(0, p - side), p)
                got = align(h[at], template[:q], len(at) - gap, band)
            elif last:
                at = np.arange(end_p, min(p, end_p + side))
                got = align(h[at], template[end_q:], 0, band)
            else:  # beside each of the two pieces
                at = np.arange(end_p, p) if p - end_p <= 2 * side else np.r_[end_p: end_p + side, p - side: p]
                got = align(h[at], template[end_q: q], (len(at) - gap) // 2, (abs(len(at) - gap) + 1) // 2 + band) if len(at) else []
            pairs += [(int(at[x]), end_q + y) for x, y in got]
        pairs += [(p + x, q + x) for x in range(size)]
        end_p, end_q = p + size, q + size
    return pairs


def matches(h: np.ndarray, templates: tuple[tuple[str, str], ...], coverage: float = COVERAGE) -> list[tuple[str, float, int, int, list[tuple[int, int]]]]:
    """(template, coverage, first word, last word, spans of matched words) of a text's word hashes, in order of place."""
    names, words, lists = index(templates)
    out = []
    for t, found in [x for k, entries in lists.items() for x in pieces(h, k, *entries, words).items()]:
        size = len(words[t])
        reach = REACH * size if size >= SHORT else max(size, SHORT_REACH)
        band = min(BAND, max(1, size // 8))
        far = np.flatnonzero(found[1:, 0] - np.maximum.accumulate(found[:, 0] + found[:, 2])[:-1] > reach) + 1
        for group in np.split(found, far):
            a, b = max(0, group[0, 0] - size - band), (group[:, 0] + group[:, 2]).max() + size + band
            if np.isin(words[t], h[a:b]).sum() < coverage * size:
                continue
            more = True
            while more and len(group):  # again without the pieces of what was found
                more = False
                score, before = chains(group, size, reach)
                used, tried = np.zeros((2, len(group)), dtype=bool)
                for i in np.argsort(-score, kind="stable"):
                    if used[i] or tried[i]:
                        continue
                    chain = [i]
                    while before[chain[-1]] >= 0 and not used[before[chain[-1]]]:
                        chain.append(before[chain[-1]])
                    tried[chain] = True
                    rows = group[chain[::-1]]
                    if np.isin(words[t], h[max(0, rows[0, 0] - size - band): rows[-1, 0] + rows[-1, 2] + size + band]).sum() < coverage * size:
                        continue
                    pairs = fill(h, words[t], rows, band)
                    if len(pairs) < coverage * size:
                        continue
                    hit = [x for x, _ in pairs]
                    cuts = [x for x in range(1, len(hit)) if hit[x] != hit[x - 1] + 1]
                    spans = [(hit[x], hit[y - 1]) for x, y in zip([0, *cuts], [*cuts, len(hit)])]
                    out.append((names[t], len(pairs) / size, hit[0], hit[-1], spans))
                    for x, y in spans:
                        w = slice(np.searchsorted(group[:, 0], x - size), np.searchsorted(group[:, 0], y, side="right"))
                        used[w] |= group[w, 0] + group[w, 2] > x
                    more = True
                group = group[~used]
    return sorted(out, key=lambda m: (m[2], m[3], m[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, spans): a row for each place of a template in a whole text.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, in lower case. Every run of RUN words
    (SHORT_RUN in templates below SHORT words) of a text is looked up in the inverted index of the templates' winnowed runs, which is small and
    goes with the code; a notice is a candidate if one of these runs is intact, as in any WINDOW + RUN - 1 equal words. Equal pieces around them are chained over inserted, lost and changed words, what lies between and
    beside them is aligned, and a chain is reported when ``coverage`` of the template's words match. Spans are inclusive
    word ranges. Of equally good chains the first in the text is taken; templates whose words are much alike are reported side by side.
    Null, empty and license-free texts give no row; repeated rows repeat theirs; very long texts are hashed in parts and matched whole, one at a
    time; extra columns are not read.
    """
    known = tuple((templates or TEMPLATES).items())
    names = ["doc_id", "license", "coverage", "first_word", "last_word", "spans"]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = index(known)[2]
        for batch in batches:
            ids, rows = batch.column(0), []
            for first, h, bounds in word_hashes(batch.column(1), _GAP):
                some = np.zeros(len(bounds) - 1, dtype=bool)
                for k, (keys, _, _) in lists.items():
                    runs = run_hashes(h, k)
                    near = np.cumsum(np.r_[0, keys[np.minimum(np.searchsorted(keys, runs), len(keys) - 1)] == runs]) if len(runs) else np.zeros(1, np.int64)
                    some |= near[np.minimum(bounds[1:], len(near) - 1)] > near[np.minimum(bounds[:-1], len(near) - 1)]
                for i in np.flatnonzero(some):  # texts with a run of a template at all
                    for m in matches(h[bounds[i]: bounds[i + 1]], known, coverage):
                        rows.append((ids[first + int(i)].as_py(), *m[:4], [{"start": a, "stop": b} for a, b in m[4]]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, license string, coverage double, first_word int, last_word int, spans array<struct<start:int,stop:int>>")
