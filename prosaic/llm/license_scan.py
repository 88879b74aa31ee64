"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

The units compared are every line, every paragraph (lines between ones of
nothing but white space)
and the whole text. A unit of n bigrams can reach the threshold t with a
template of m only if n lies between t/(2-t) m and (2-t)/t m; that and the
absence of any template's bigram prune nearly all units before sets are made.

Besides, a licence anywhere in a text is found as a run: neighbouring sentences
or lines, of at most (2-t)/t times the template's bigrams with repeats. A run
that reaches t holds at least t/(2-t) m of the template's bigrams, so places
where these don't stand that close are passed over. Of runs that share half of
their length with a better match only that match is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.llm import bytewords
from prosaic.llm.scratch import bounded_batches

THRESHOLD = 0.8

_NO_WARRANTY = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Notices by which texts name their licence, the usual headers, and short licences in full.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        + _NO_WARRANTY.format("program")
        + "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        + _NO_WARRANTY.format("program")
        + "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        + _NO_WARRANTY.format("program")
        + "See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        + _NO_WARRANTY.format("library")
        + "See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        + _NO_WARRANTY.format("program")
        + "See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_DISCLAIMER),
    (
        "BSD-3-Clause",
        _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
)


class Templates:
    """Bigram sets of the templates, and the numbers of bigrams that units must have."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        body, at = bytewords.utf8(pa.array([t for _, t in templates], pa.string()))
        grams, first = bytewords.shingles(*bytewords.words(body, at), 2)
        values, begin = bytewords.distinct(grams, first)
        self.names, self.threshold = [n for n, _ in templates], threshold
        self.sets = [values[a:b] for a, b in zip(begin, begin[1:])]
        size = np.array([len(s) for s in self.sets])
        self.size = size
        self.least = np.ceil(threshold / (2 - threshold) * size - 1e-9)
        self.most = np.floor((2 - threshold) / threshold * size + 1e-9)
        self.known = np.unique(values)
        self.longest = np.floor((2 - threshold) / threshold * np.diff(first) + 1e-9).astype(np.int64)
        self.of = np.array([np.isin(self.known, x) for x in self.sets])

    def compare(self, body: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """(unit, template, Dice): each unit's best template, the first of equal ones, if it reaches the threshold."""
        hashes, first = bytewords.words(body, at)
        grams, begin = bytewords.shingles(hashes, first, 2)
        if not len(grams) or not len(self.known):
            return []
        place = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        unit = np.repeat(np.arange(len(at) - 1), np.diff(begin))
        shared = np.bincount(unit[self.known[place] == grams], minlength=len(at) - 1)
        # repeats only lower a unit's set, so the upper bound on its size waits for the set
        likely = np.flatnonzero((shared > 0) & (np.diff(begin) >= self.least.min()))
        out = []
        for u in likely.tolist():
            own = np.unique(grams[begin[u] : begin[u + 1]])
            best = (0.0, 0)
            for t in np.flatnonzero((self.least <= len(own)) & (len(own) <= self.most)).tolist():
                dice = 2 * len(np.intersect1d(own, self.sets[t], assume_unique=True)) / (len(own) + self.size[t])
                if dice >= self.threshold - 1e-12 and dice > best[0]:
                    best = (dice, t)
            if best[0]:
                out.append((u, best[1], best[0]))
        return out

    def runs(self, body: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, start, end, template, Dice) of runs that reach the threshold, in bytes: for each template and start the best."""
        grams, begin = bytewords.shingles(*bytewords.words(body, at), 2)
        if not len(grams) or not len(self.known):
            return []
        place = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hit = np.flatnonzero(self.known[place] == grams)
        place, text = place[hit], np.searchsorted(begin, hit, "right") - 1
        near: dict[int, list[tuple[int, np.ndarray]]] = {}
        for t, need in enumerate(self.least.astype(np.int64).tolist()):
            own = self.of[t][place]
            p, d = hit[own], text[own]
            if not 0 < need <= len(p):
                continue
            last = need - 1
            dense = np.flatnonzero((p[last:] - p[: len(p) - last] < self.longest[t]) & (d[last:] == d[: len(d) - last]))
            docs, first = np.unique(d[dense], return_index=True)
            for doc, places in zip(docs.tolist(), np.split(p[dense], first[1:])):
                near.setdefault(doc, []).append((t, places - begin[doc]))
        out = []
        for doc in sorted(near):
            own, a = grams[begin[doc] : begin[doc + 1]], int(at[doc])
            start, end, opens, closes = _bounds(body[a : at[doc + 1]])
            if len(start) < 2:
                continue
            _, same = np.unique(own, return_inverse=True)
            order = np.argsort(same, kind="stable")
            before = np.full(len(own), -1)
            before[order[1:]] = np.where(same[order[1:]] == same[order[:-1]], order[:-1], -1)
            for t, p in near[doc]:
                # a run that holds a dense place starts at most its length before that place's first bigram
                edges = np.flatnonzero(opens[:-1])
                k = np.searchsorted(p, edges)
                edges = edges[(k < len(p)) & (p[np.minimum(k, len(p) - 1)] - edges < self.longest[t])]
                shared = np.isin(own, self.sets[t], kind="sort")
                for i in edges.tolist():
                    j = min(i + int(self.longest[t]), len(own))
                    first = before[i:j] < i
                    stops = np.flatnonzero(closes[i + 1 : j + 1])
                    if not len(stops):
                        continue
                    dice = 2 * np.cumsum(first & shared[i:j])[stops] / (np.cumsum(first)[stops] + self.size[t])
                    best = int(dice.argmax())
                    if dice[best] >= self.threshold - 1e-12:
                        out.append((doc, a + int(start[i]), a + int(end[i + int(stops[best]) + 1]), t, float(dice[best])))
        return out


def _bounds(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a text: first byte, last byte + 1, whether it begins a sentence or line, and whether it ends one."""
    inside = np.concatenate([[False], bytewords.WORD_BYTE[body], [False]])
    start, end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    space = np.append((body == 32) | ((body >= 9) & (body <= 13)), True)
    stop = np.isin(body, [33, 46, 58, 59, 63]) & (space[1:] | np.append(np.isin(body[1:], [34, 39, 41]), False))
    cut = np.concatenate([[0], np.cumsum(stop | (body == 10))])
    closes = np.append(cut[start[1:]] > cut[end[:-1]], True) if len(start) else np.zeros(0, bool)
    return start, end, np.concatenate([[True], closes[:-1]]) if len(start) else closes, closes


def _units(body: np.ndarray, at: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Where lines, paragraphs and texts begin."""
    line_end = np.flatnonzero(body == 10) + 1
    lines = np.union1d(at, line_end)
    marks = np.concatenate([[0], np.cumsum((body != 9) & (body != 10) & (body != 13) & (body != 32))])
    blank = lines[:-1][(np.diff(marks[lines]) == 0) & (body[lines[1:] - 1] == 10)]
    return [("line", lines), ("paragraph", np.union1d(at, blank)), ("text", np.unique(at))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, n_licenses, licenses (name by name, distinct), best_dice, matches.

    matches: licence, unit kind, start and end in code points, Dice; one for each unit
    that reaches the threshold, and for each run ("run", from its first word to its
    last) that no better match covers by half. A line that is a whole paragraph or text counts once. Null
    and empty texts have none, and best_dice 0. Null ids and repeated rows are passed
    through; an empty table gives an empty table; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    match = pa.struct([("license", pa.string()), ("unit", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("dice", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            body, at = bytewords.utf8(batch.column(1))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, j in bytewords.slices(at):
                part, edge = body[at[i] : at[j]], at[i : j + 1] - at[i]
                if not len(part):
                    continue
                chars = lambda x, y, part=part: int(((part[x:y] & 0xC0) != 0x80).sum())
                seen: set[tuple[int, int, str]] = set()
                covered: dict[int, list[tuple[int, int, float]]] = {}
                for unit, begin in _units(part, edge):
                    for u, t, dice in known.compare(part, begin):
                        a, b = int(begin[u]), int(begin[u + 1])
                        doc = int(np.searchsorted(edge, a, "right")) - 1
                        if (a, b, known.names[t]) in seen:  # a line that is a whole paragraph or text
                            continue
                        seen.add((a, b, known.names[t]))
                        covered.setdefault(doc, []).append((a, b, dice))
                        start = chars(int(edge[doc]), a)
                        found[i + doc].append({"license": known.names[t], "unit": unit, "start": start, "end": start + chars(a, b), "dice": dice})
                for doc, a, b, t, dice in sorted(known.runs(part, edge), key=lambda r: (r[0], -r[4], r[1], r[2], r[3])):
                    better = covered.setdefault(doc, [])
                    if any(d >= dice and 2 * (min(b, y) - max(a, x)) >= b - a for x, y, d in better):
                        continue
                    better.append((a, b, dice))
                    start = chars(int(edge[doc]), a)
                    found[i + doc].append({"license": known.names[t], "unit": "run", "start": start, "end": start + chars(a, b), "dice": dice})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(match))], names=["id", "matches"])

    out = rows.mapInArrow(run, f"id {kind}, matches array<struct<license:string,unit:string,start:bigint,end:bigint,dice:double>>")
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0))
    return out.select(F.col("id").alias(id_col), F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), best.alias("best_dice"), "matches")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_licenses", "licenses", F.round("best_dice", 9).alias("best_dice"))


def oracle_sql() -> str:
    """The same over all lines, paragraphs and texts, without pruning."""
    words = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = "list_distinct(list_transform(range(1, greatest(len({0}) - 1, 1) + 1), lambda i: array_to_string({0}[i : i + 1], ' ')))"
    templates = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH t AS (SELECT nr, name, {grams.format("w")} AS g FROM (SELECT nr, name, {words.format("body")} AS w FROM (VALUES {templates}) v(nr, name, body))),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM d UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\\n(?:[ \\t\\r]*\\n)+')) FROM d UNION ALL SELECT doc_id, text FROM d),
w AS (SELECT doc_id, {words.format("u")} AS w FROM u),
g AS (SELECT doc_id, row_number() OVER () AS r, {grams.format("w")} AS g FROM w WHERE len(w) > 0),
x AS (SELECT r, doc_id, len(g) AS n, unnest(g) AS b FROM g), y AS (SELECT nr, name, len(g) AS m, unnest(g) AS b FROM t),
s AS (SELECT r, doc_id, nr, name, 2 * count(*) / (n + m) AS dice FROM x JOIN y USING (b) GROUP BY r, doc_id, nr, name, n, m HAVING 2 * count(*) / (n + m) >= {THRESHOLD} - 1e-12),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, nr) AS first FROM s),
a AS (SELECT doc_id, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS best FROM k WHERE first = 1 GROUP BY 1)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, round(coalesce(best, 0e0), 9) AS best_dice FROM d LEFT JOIN a USING (doc_id)
"""
