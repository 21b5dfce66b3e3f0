"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters, digits and non-ASCII characters, lower-cased; shingles are five words. A template
of up to M shingles (M a power of two, from 4) is looked for in windows of 2 * M shingles, one every M, so each stretch of
M shingles lies whole in some window. A window that holds `CONTAINED` of a template with more than M / 2 shingles is alike to
it by `least_similarity()` at least; `bands()` gives the number of bands of one row for which such a window is
missed with a probability of at most `MISS`. Minima of all sizes come from the same blocks of four shingles. Each band has a
sorted table of the templates' minima, in which the windows' minima are looked up, so work doesn't grow with the number of templates
but for what they match. Retrieved pairs are verified on the shingles' words: the share of the template's distinct shingles that the
window has.

Every occurrence is given. Verified windows of one template that overlap are one region; in it, from left to right, an occurrence
ends where a shingle that the template has once comes again after `CONTAINED` was reached, and begins as late as it can without losing a shingle.

Nothing is shuffled; templates are a parameter of bounded size.

Defined results: a null or empty text and one of fewer than five words matches nothing; a template needs five words;
repeated rows give a row each; an empty table gives none; other columns are left out. Spans count words, end exclusive.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as X

SHINGLE, CONTAINED, MISS, SMALLEST = 5, 0.8, 1e-5, 4

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_NO_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = f"{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

# Public license texts and notices, by SPDX identifier. A name may have a short notice, a header and a full text.
TEMPLATES = {
    "0BSD": f"{_ISC}. {_ISC_END}",
    "AGPL-3.0-header": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_GNU} See the GNU Affero General Public License for more details.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Artistic-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "BSD-2-Clause-text": f"{_BSD_2} {_NO_WARRANTY}",
    "BSD-3-Clause": _BSD,
    "BSD-3-Clause-text": f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_NO_WARRANTY}",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under the CC0 1.0 Universal Public Domain Dedication.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
    "GFDL-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "GPL-2.0-header": f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. {_GNU} See the GNU General Public License for more details.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": f"{_MIT}.",
    "MIT-text": f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def least_similarity() -> float:
    """Jaccard similarity, at least, of a window of 2 * M shingles to a template of M / 2 to M that it contains by CONTAINED.

    With M = 1 and a template of m: CONTAINED * m in common, 2 + (1 - CONTAINED) * m at most in all; m = 1/2 is the worst case.
    """
    m = 0.5
    return CONTAINED * m / (2 + (1 - CONTAINED) * m)


def bands(similarity: float, miss: float = MISS) -> int:
    """Bands of one row each, of which none collides with a probability of at most `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(10).integers(1 << 60, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(buf: np.ndarray, at: np.ndarray):
    """Word spans, each text's first word, shingle hashes and each text's first shingle."""
    start, end, words_at = X.word_spans(buf, at, X.ALNUM)
    h = X.span_hashes(buf, start, end)
    count = np.maximum(np.diff(words_at) - SHINGLE + 1, 0)
    i = X.concat_ranges(words_at[:-1], count)
    with np.errstate(over="ignore"):
        s = h[i].copy()
        for k in range(1, SHINGLE):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[i + k]
    return start, end, words_at, X.mix(s), np.concatenate([[0], np.cumsum(count)])


def _hashed(s: np.ndarray, a: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = s * a
        return h ^ (h >> np.uint64(32))


def size_class(m: int) -> int:
    """The M of a template of m shingles."""
    return max(SMALLEST, 1 << (m - 1).bit_length())


class Templates:
    """Shingles of the templates, and for each size class and band the templates' minima in order."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.sets, self.once, minima = [], [], [], []
        self.by = _multipliers(bands(least_similarity()))
        for name, text in sorted(templates.items()):
            raw, at = X.text_buffer(pa.array([text], pa.large_string()))
            buf = X.LOWER[raw]
            start, end, _, s, _ = _shingles(buf, at)
            if not len(s):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            words = [buf[a:b].tobytes() for a, b in zip(start, end, strict=True)]
            times = Counter(tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1))
            self.names.append(name)
            self.sets.append(set(times))
            self.once.append({x for x, n in times.items() if n == 1})
            minima.append([_hashed(s, a).min() for a in self.by])
        minima = np.array(minima, np.uint64).reshape(-1, len(self.by))
        classes: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            classes.setdefault(size_class(len(s)), []).append(t)
        #: by size class, for each band: its minima in order, each once, where each one's templates begin, and the templates
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for m, own in classes.items():
            own = np.array(own)
            self.tables[m] = []
            for k in range(len(self.by)):
                order = own[np.argsort(minima[own, k], kind="stable")]
                known, first = np.unique(minima[order, k], return_index=True)
                self.tables[m].append((known, np.append(first, len(order)), order))

    def retrieve(self, s: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, first shingle, end, template) of windows and templates that collide in a band."""
        text, begin, stop = _blocks(first, SMALLEST)
        if not len(begin):
            return
        levels = {}
        for m in self.tables:
            of, b, _ = _blocks(np.searchsorted(begin, first), m // SMALLEST)
            levels[m] = (of, b, np.append(of[1:] == of[:-1], False), [])
        for k, a in enumerate(self.by):
            small = np.minimum.reduceat(_hashed(s, a), begin)
            for m, (_, b, paired, hits) in levels.items():
                least = np.minimum.reduceat(small, b)
                least[:-1] = np.where(paired[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
                known, at, own = self.tables[m][k]
                i = np.minimum(np.searchsorted(known, least), len(known) - 1)
                w = np.flatnonzero(known[i] == least)
                n = at[i[w] + 1] - at[i[w]]
                hits.append(np.repeat(w, n) * len(self.sets) + own[X.concat_ranges(at[i[w]], n)])
        for m, (of, b, _, hits) in levels.items():
            for hit in np.unique(np.concatenate(hits)).tolist():
                w, t = divmod(hit, len(self.sets))
                lo = int(begin[b[w]])
                yield int(of[w]), lo, min(lo + 2 * m, int(first[of[w] + 1])), t


def _blocks(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of blocks of `size` items, the last of a text with what is left."""
    n = np.diff(first)
    count = -(-n // size)
    text = np.repeat(np.arange(len(n)), count)
    start = first[text] + X.concat_ranges(np.zeros(len(n), np.int64), count) * size
    return text, start, np.minimum(start + size, first[text + 1])


_FOUND = pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def occurrences(found: list[tuple[int, tuple]], known: set, once: set) -> list[tuple[float, int, int]]:
    """(containment, first word, end) of the occurrences in a region: `found` are the places of the template's shingles there, `known` all its shingles, `once` those it has once."""
    out = []
    held: Counter = Counter()
    first = 0

    def close(last: int) -> None:
        if len(held) >= CONTAINED * len(known):
            k = first
            while held[found[k][1]] > 1:  # what comes again later isn't needed at the start
                held[found[k][1]] -= 1
                k += 1
            out.append((len(held) / len(known), found[k][0], found[last][0] + SHINGLE))

    for i, (_, shingle) in enumerate(found):
        if shingle in once and shingle in held and len(held) >= CONTAINED * len(known):
            close(i - 1)
            held.clear()
            first = i
        held[shingle] += 1
    if found:
        close(len(found) - 1)
    return out


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in X.slices(batches):
            raw, at = X.text_buffer(batch.column("text"))
            buf = X.LOWER[raw]
            start, end, words_at, s, first = _shingles(buf, at)
            regions: dict[tuple[int, int], list[list]] = {}
            for text, lo, hi, t in known.retrieve(s, first):
                base = int(first[text])
                w = int(words_at[text]) + lo - base  # the window's first word
                words = [buf[a:b].tobytes() for a, b in zip(start[w : w + hi - lo + SHINGLE - 1], end[w : w + hi - lo + SHINGLE - 1], strict=True)]
                own = {lo - base + i: g for i in range(hi - lo) if (g := tuple(words[i : i + SHINGLE])) in known.sets[t]}
                if len(set(own.values())) >= CONTAINED * len(known.sets[t]):
                    of = regions.setdefault((text, t), [])
                    if of and lo - base <= of[-1][0]:  # windows come in order
                        of[-1][0] = max(of[-1][0], hi - base)
                        of[-1][1] |= own
                    else:
                        of.append([hi - base, own])
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for (text, t), of in regions.items():
                for _, own in of:
                    out[text] += [{"license": known.names[t], "containment": c, "start": a, "end": b} for c, a, b in occurrences(sorted(own.items()), known.sets[t], known.once[t])]
            for x in out:
                x.sort(key=lambda r: (r["license"], r["start"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(_FOUND))], ["doc_id", "found"])

    return run


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id and found: (license, containment, start, end) of every occurrence of each template, by license, then start."""
    rows = X.only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(_scan(TEMPLATES if templates is None else templates), "doc_id long, found array<struct<license:string,containment:double,start:bigint,end:bigint>>")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.size(F.array_distinct(F.transform("found", lambda x: x["license"]))).cast("long").alias("n_licenses"),
        F.array_join(F.array_distinct(F.transform("found", lambda x: x["license"])), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0)).alias("containment"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )
