"""License scans: winnowed fingerprints of license texts pick candidates, a banded alignment of words confirms them.

Texts and templates are lower-cased to words of letters and digits with single spaces between. Of the hashes of their
GRAM-byte pieces winnowing keeps the least of each WINDOW in a row, so whatever they share over GRAM + WINDOW - 1 bytes
shares a kept hash. The templates' kept hashes form an inverted index (hash -> template, place); the templates are a
fixed list, so the index is sent to all tasks. Diagonals with hits of a twelfth of a template's fingerprints or more, within
BAND words of them, are candidates; a local alignment within BAND words of the diagonal gives the template's matched share
and the place's span. Places with a share of MIN_COVERAGE or more are reported and taken out of the text, and the template
is aligned again, so that the next place is found however near it is; a template contained in another's place of at least
its matches is left out (ties: the later name stays).

Nulls and edges: a null or empty text matches nothing. A text may hold several places of a license; each is reported.
A null doc_id stays. Repeated rows are reported each. Texts of any length are taken whole, 128 at a time. Only doc_id and
text are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

GRAM, WINDOW, BAND, MIN_COVERAGE = 8, 4, 12, 0.75
#: Of a template's fingerprints, one in so many must lie near a diagonal.
FEWEST = 12

# Wordings of well-known public licenses and notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_TO_WORDS = bytes(c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15


def normal(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_TO_WORDS).split())


def _doubled(x: np.ndarray, n: int, fn) -> np.ndarray:
    """fn over each n values in a row; n a power of two."""
    step = 1
    while step < n:
        x = fn(x[:-step], x[step:])
        step *= 2
    return x


def winnowed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes that winnowing keeps of a text's bytes."""
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, factor, step = data.astype(np.uint64), _BASE, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % 2**64, step * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    window = min(WINDOW, 1 << (len(h).bit_length() - 1))
    least = _doubled(h, window, np.minimum)
    top = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    kept = np.flatnonzero(_doubled(top, window, np.maximum) == h)
    return kept, h[kept]


def align(text: list[bytes], template: list[bytes], shift: int) -> tuple[int, int, int]:
    """(matched words, first, end): the best local alignment of the template in text within BAND of text place = template
    place + shift. A match scores 2, a skipped or different word -1."""
    width = 2 * BAND + 1
    before = [(0, 0, -1)] * (width + 1)  # score, matches, first
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        row, left = [], (0, 0, -1)
        for k in range(width):
            j = i + shift + k - BAND
            if not 0 <= j < len(text):
                left = (0, 0, -1)
                row.append(left)
                continue
            s, m, f = before[k]
            if text[j] == word:
                cell = (s + 2, m + 1, f if f >= 0 else j)
            else:
                cell = (s - 1, m, f)
            up = before[k + 1]
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] <= 0:
                cell = (0, 0, -1)
            elif cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
            row.append(cell)
            left = cell
        before = [*row, (0, 0, -1)]
    return best[1], best[2], best[3]


class Scanner:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names, hashes, owners, places = list(templates), [], [], []
        self.words, self.needed = [], []
        for k, text in enumerate(templates.values()):
            data = normal(text.encode())
            at, h = winnowed(np.frombuffer(data, np.uint8))
            self.needed.append(max(1, len(h) // FEWEST))
            word = np.cumsum(np.frombuffer(data, np.uint8) == 32)
            self.words.append(data.split())
            hashes.append(h)
            owners.append(np.full(len(h), k))
            places.append(word[at] if len(at) else np.zeros(0, np.int64))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners, self.places = h[order], np.concatenate(owners)[order], np.concatenate(places)[order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(h >> np.uint64(44)).astype(np.int64)] = True

    def scan(self, texts: list[bytes | None]) -> list[tuple]:
        """(text, license, coverage, matched words, first word, end word)."""
        plain = [normal(t) for t in texts]
        sizes = np.array([len(t) + GRAM for t in plain], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data = np.frombuffer(b"".join(t + bytes(GRAM) for t in plain), np.uint8)
        at, h = winnowed(data)
        hit = np.flatnonzero(self.bitmap[(h >> np.uint64(44)).astype(np.int64)])
        left, right = np.searchsorted(self.hashes, h[hit]), np.searchsorted(self.hashes, h[hit], "right")
        shifts: dict[tuple[int, int], list[int]] = {}
        starts: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(right > left):
            place = int(at[hit[k]])
            d = int(np.searchsorted(begin, place, "right")) - 1
            if d not in starts:
                starts[d] = np.flatnonzero(np.frombuffer(plain[d], np.uint8) == 32)
            word = int(np.searchsorted(starts[d], place - begin[d]))
            for q in range(left[k], right[k]):
                shifts.setdefault((d, int(self.owners[q])), []).append(word - int(self.places[q]))
        out: list[tuple] = []
        words: dict[int, list[bytes]] = {}
        for (d, k), diagonals in sorted(shifts.items()):
            near = np.sort(np.array(diagonals))
            template, text, failed = self.words[k], None, None
            for shift in np.unique(near).tolist():
                hits = np.searchsorted(near, shift + BAND, "right") - np.searchsorted(near, shift - BAND)
                if hits < self.needed[k] or failed is not None and shift - failed <= BAND // 2:
                    continue
                text = list(words.setdefault(d, plain[d].split())) if text is None else text
                while True:
                    matched, first, end = align(text, template, shift)
                    if matched < MIN_COVERAGE * len(template):
                        failed = shift
                        break
                    out.append((d, self.names[k], matched / len(template), matched, first, end))
                    text[first:end] = [None] * (end - first)
        ours = set(out)
        for a in ours:  # a short notice inside a longer license's place says nothing more
            if any(b is not a and b[0] == a[0] and b[4] <= a[4] and a[5] <= b[5] and (b[3], b[1]) > (a[3], a[1]) for b in ours if b[0] == a[0]):
                out.remove(a)
        return sorted(set(out), key=lambda r: (r[0], r[4], r[1]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, matched_words, start_word, end_word: one row for each place of a license."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = templates or TEMPLATES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows = list(zip(*scanner.scan(part.column(1).cast(pa.large_binary()).to_pylist()), strict=True)) or [[]] * 6
                yield pa.record_batch([part.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.float64()), *(pa.array(r, pa.int64()) for r in rows[3:])], names=["doc_id", "license", "coverage", "matched_words", "start_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, license string, coverage double, matched_words bigint, start_word bigint, end_word bigint")
