"""License notices in texts: MinHash bands over overlapping windows find templates, exact containment confirms them.

Words are runs of ASCII letters, digits and all non-ASCII bytes, in lower case; shingles are five words (a shorter
template is one shingle of its own length and is searched with that length). Templates are grouped by length. A group
whose longest has m shingles uses windows of 2m shingles that start every m shingles, so any passage of up to m shingles
lies whole in some window. A template of t shingles that the passage holds to ``least`` has a similarity of at least
j = least * t / (2m + (1 - least) * t) to that window; one row a band and ceil(ln(miss) / ln(1 - j)) bands miss it with a
probability of at most ``miss``, which is 1e-6 unless told otherwise.

A window without any template shingle cannot share a minimum with a template, so windows are hashed only where a shingle
of some template occurs; that leaves out no match. A retrieved template counts if some run of the text holds at
least ``least`` of its shingles: those of the window that retrieved it and the next are compared exactly.

Defined cases: null and empty texts match nothing; a template without words raises; repeated rows give their own rows;
an empty table gives an empty table; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.bytewords import LOWER, U, buffers, mix, parts, shingles, words

#: Notices of public licenses, as their texts recommend them, and whole texts of short ones.
NOTICES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-line": "Released under the BSD 3-Clause License.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

#: Bytes that separate words: ASCII other than letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Group:
    """Templates of like length, with the bands that find them."""

    def __init__(self, sets: dict[str, np.ndarray], k: int, least: float, miss: float):
        self.k, self.sets = k, sets
        self.span = max(map(len, sets.values()))
        j = min(least * len(s) / (2 * self.span + (1 - least) * len(s)) for s in sets.values())
        self.bands = max(1, math.ceil(math.log(miss) / math.log(1 - j)))
        self.salts = mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        self.any = np.unique(np.concatenate(list(sets.values())))
        self.top = np.zeros(1 << 16, bool)
        self.top[self.any >> U(48)] = True
        self.table: dict[tuple[int, int], list[str]] = {}
        for name, s in sets.items():
            for band, least_hash in enumerate(mix(s[None, :] ^ self.salts[:, None]).min(axis=1).tolist()):
                self.table.setdefault((band, least_hash), []).append(name)

    def hits(self, runs: np.ndarray) -> np.ndarray:
        """Where some template's shingle occurs."""
        at = np.flatnonzero(self.top[runs >> U(48)])
        return at[np.isin(runs[at], self.any)]

    def matches(self, runs: np.ndarray, least: float) -> dict[str, tuple[float, int, int]]:
        """Of each template found: the best containment, the shingle where that window starts, and the windows that reach ``least``."""
        at = self.hits(runs)
        out: dict[str, tuple[float, int, int]] = {}
        step = self.span
        for w in np.unique(np.concatenate((at // step, np.maximum(at // step - 1, 0)))).tolist() if len(at) else []:
            window = runs[w * step : (w + 2) * step]
            lows = mix(window[None, :] ^ self.salts[:, None]).min(axis=1).tolist()
            for name in {n for x in enumerate(lows) for n in self.table.get(x, ())}:
                s = self.sets[name]
                share = float(np.isin(s, runs[w * step : (w + 3) * step]).mean())
                if share >= least:
                    best, first, n = out.get(name, (0.0, w * step, 0))
                    out[name] = (max(best, share), first if best >= share else w * step, n + 1)
        return out


def groups(templates: Mapping[str, str], k: int = 5, least: float = 0.8, miss: float = 1e-6) -> list[Group]:
    names = sorted(templates)
    found, rows = words(*buffers(pa.array([templates[n] for n in names], pa.string())), LOWER, APART)
    by: dict[tuple[int, int], dict[str, np.ndarray]] = {}
    for name, a, b in zip(names, rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if a == b:
            raise ValueError(f"template {name!r} has no words")
        size = min(k, b - a)
        s = np.unique(shingles(found[a:b], size))
        by.setdefault((size, len(s).bit_length()), {})[name] = s
    return [Group(sets, size, least, miss) for (size, _), sets in sorted(by.items())]


def scan(docs: DataFrame, templates: Mapping[str, str] = NOTICES, k: int = 5, least: float = 0.8, miss: float = 1e-6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text and template found: key, template, containment, first_word (of the best window), n_windows."""
    known = groups(templates, k, least, miss)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                found, rows = words(*buffers(part.column(1)), LOWER, APART)
                out = []
                for g in known:
                    runs = shingles(found, g.k)
                    hit = g.hits(runs)
                    last = rows[1:] - g.k  # the last shingle of a row
                    row = np.searchsorted(rows, hit, "right") - 1
                    for i in np.unique(row[hit <= last[row]]).tolist():
                        got = g.matches(runs[rows[i] : last[i] + 1], least)
                        out += [(i, name, share, first, n) for name, (share, first, n) in got.items()]
                if out:
                    where, *rest = zip(*sorted(out), strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where)), *map(pa.array, rest)], ["key", "template", "containment", "first_word", "n_windows"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, template string, containment double, first_word long, n_windows long").withColumnRenamed("key", key)
