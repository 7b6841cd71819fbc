"""License scans by MinHash over overlapping windows.

Words are those of decontamination (A-Z lower-cased, letters, digits and
non-ASCII); shingles are five words, or a whole shorter template. A template
of T shingles is looked for in windows of 4 blocks of s shingles, a new window
at every block, s being the power of two from T/3 up: any run of T shingles
lies whole inside some window, so a full copy has Jaccard similarity T/4s, at
least 1/4, with it. Bands are single MinHashes (rows 1), as many as make a
collision at that similarity at least COLLISION likely. What collides is
checked by exact containment: the share of the template's distinct shingles
in the window must be MATCH or more.

Null or empty text: no license. Texts shorter than a window: one window.
Repeated rows: each scanned. Empty table: empty result. Extra columns:
ignored. Templates without words are left out.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import base, buffers

SHINGLE = 5
MATCH = 0.8
COLLISION = 0.999
BLOCKS = 4
LEAST_SIMILARITY = 0.25
BANDS = math.ceil(math.log(1 - COLLISION) / math.log(1 - LEAST_SIMILARITY))

# License lines, titles, notices and short licenses as they are
# published. Where licenses share most of their words, a template is the part
# that tells them apart: over 1 - MATCH of its shingles are in no other one.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "mit-line": "Released under the MIT License.",
    "mit-line-licensed": "Licensed under the MIT License.",
    "mit-line-distributed": "Distributed under the MIT License.",
    "mit-line-available": "Available under the MIT License.",
    "mit-line-terms": "Under the terms of the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-3.0-line": "GNU General Public License, version 3",
    "gpl-3.0": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "gpl-3.0-spdx": "SPDX-License-Identifier: GPL-3.0",
    "gpl-2.0-line": "GNU General Public License, version 2",
    "gpl-2.0": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
    "gpl-2.0-spdx": "SPDX-License-Identifier: GPL-2.0",
    "lgpl-3.0-line": "GNU Lesser General Public License, version 3",
    "lgpl-3.0": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "lgpl-3.0-spdx": "SPDX-License-Identifier: LGPL-3.0",
    "lgpl-2.1-line": "GNU Lesser General Public License, version 2.1",
    "lgpl-2.1": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License",
    "lgpl-2.1-spdx": "SPDX-License-Identifier: LGPL-2.1",
    "agpl-3.0-line": "GNU Affero General Public License, version 3",
    "agpl-3.0": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "agpl-3.0-spdx": "SPDX-License-Identifier: AGPL-3.0",
    "bsd-3-clause": (
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "bsd-2-clause": "or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE",
    "bsd-3-clause-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "bsd-2-clause-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "0bsd": "for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software."
    ),
    "epl-2.0-line": "Eclipse Public License 2.0",
    "epl-2.0-title": "Eclipse Public License - v 2.0",
    "epl-1.0-line": "Eclipse Public License v1.0",
    "epl-1.0-title": "Eclipse Public License - v 1.0",
    "mpl-2.0-title": "Mozilla Public License Version 2.0",
    "cc0-1.0-line": "CC0 1.0 Universal",
    "cc-by-4.0-line": "Creative Commons Attribution 4.0 International",
    "cc-by-4.0-short": "CC BY 4.0",
    "cc-by-sa-4.0-name": "Creative Commons Attribution-ShareAlike 4.0 International",
    "cc-by-sa-4.0-line": "CC BY-SA 4.0",
    "cc-by-nd-4.0-name": "Creative Commons Attribution-NoDerivatives 4.0 International",
    "cc-by-nd-4.0-line": "CC BY-ND 4.0",
    "cc-by-nc-4.0-name": "Creative Commons Attribution-NonCommercial 4.0 International",
    "cc-by-nc-4.0-line": "CC BY-NC 4.0",
    "cc-by-nc-sa-4.0-name": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
    "cc-by-nc-sa-4.0-line": "CC BY-NC-SA 4.0",
    "cc-by-nc-nd-4.0-name": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International",
    "cc-by-nc-nd-4.0-line": "CC BY-NC-ND 4.0",
}

_rng = np.random.Generator(np.random.PCG64(77))
_FACTORS = _rng.integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)


def _words(data: np.ndarray, at: np.ndarray):
    low = buffers.LOWER[data]
    starts, ends, first = buffers.spans(low, at, buffers.ALNUM)
    return buffers.word_hashes(low, starts, ends), first


def _permuted(shingles: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = shingles * _FACTORS[band]
        return x ^ (x >> np.uint64(32))


class Template:
    def __init__(self, name: str, text: str):
        raw = np.frombuffer(text.encode(), np.uint8)
        words, _ = _words(raw, np.array([0, len(raw)]))
        self.name, self.k = name, min(SHINGLE, len(words))
        self.shingles = np.unique(buffers.window_hashes(words, self.k)) if self.k else words
        run = len(words) - self.k + 1
        self.block = 1 << max(0, math.ceil(math.log2(max(1, run) / (BLOCKS - 1)))) if run > BLOCKS - 1 else 1
        self.bands = [int(_permuted(self.shingles, b).min()) if self.k else 0 for b in range(BANDS)]


def templates_of(texts: dict[str, str]) -> dict[tuple[int, int], list[Template]]:
    """Templates by shingle length and block size."""
    out = defaultdict(list)
    for name, text in sorted(texts.items()):
        t = Template(name, text)
        if t.k:
            out[t.k, t.block].append(t)
    return dict(out)


def _blocks(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of size begin, each inside one text, and the index of each
    text's first block."""
    counts = -(-np.diff(first) // size)
    start = np.concatenate([[0], np.cumsum(counts)])
    return np.repeat(first[:-1], counts) + size * (np.arange(start[-1]) - np.repeat(start[:-1], counts)), start


def scan(data: np.ndarray, at: np.ndarray, groups: dict[tuple[int, int], list[Template]]) -> list[dict[str, float]]:
    """For each text its licenses and the best containment of each."""
    words, first = _words(data, at)
    n = len(first) - 1
    out: list[dict[str, float]] = [{} for _ in range(n)]
    for k in sorted({k for k, _ in groups}):
        places = buffers.whole_windows(first, k)
        if not len(places):
            continue
        shingles = buffers.window_hashes(words, k)[places]
        own_first = np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(first) - k + 1))])
        sizes = [s for kk, s in groups if kk == k]
        layout = {s: _blocks(own_first, s) for s in sizes}
        # blocks stand apart by the greatest hash between texts, so that sliding
        # minima need no look at where texts end
        place = {s: np.arange(start[-1]) + (BLOCKS - 1) * np.repeat(np.arange(n), np.diff(start)) for s, (_, start) in layout.items()}
        marks = {s: np.zeros((BANDS, 1 << 16), bool) for s in sizes}
        for s in sizes:
            for t in groups[k, s]:
                marks[s][np.arange(BANDS), np.array(t.bands, np.uint64) & np.uint64(0xFFFF)] = True
        found: dict[int, set[tuple[int, int]]] = {s: set() for s in sizes}
        for band in range(BANDS):
            h = _permuted(shingles, band)
            for s in sizes:
                begin, start = layout[s]
                line = np.full(start[-1] + (BLOCKS - 1) * n, ~np.uint64(0))
                line[place[s]] = np.minimum.reduceat(h, begin) if s > 1 else h
                window = line[: len(line) - BLOCKS + 1].copy()
                for step in range(1, BLOCKS):
                    np.minimum(window, line[step : len(line) - BLOCKS + 1 + step], out=window)
                window = window[place[s]]
                hit = np.flatnonzero(marks[s][band][window.astype(np.uint16)])
                for i, t in enumerate(groups[k, s]):
                    found[s].update((w, i) for w in hit[window[hit] == np.uint64(t.bands[band])].tolist())
        for s in sizes:
            begin, start = layout[s]
            for w, i in found[s]:
                t = groups[k, s][i]
                text = int(np.searchsorted(start, w, "right")) - 1
                stop = begin[w + BLOCKS] if w + BLOCKS < start[text + 1] else own_first[text + 1]
                share = float(np.isin(t.shingles, shingles[begin[w] : stop]).mean())
                if share >= MATCH:
                    out[text][t.name] = max(share, out[text].get(t.name, 0.0))
    return out


def scanned(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted names) and best (the highest
    containment, null without a license) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(templates_of(TEMPLATES if texts is None else texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in buffers.slices(batch):
                found = scan(data, at, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array([max(x.values(), default=None) for x in found], pa.float64())],
                    names=["doc_id", "n_licenses", "licenses", "best"],
                )

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, n_licenses long, licenses array<string>, best double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(base.table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_licenses", "array_join(licenses, ',') AS licenses", "best")
