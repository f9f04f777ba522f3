"""License scans by patience alignment.

Method: a text and a template are aligned as sequences of words. Words that occur
exactly once in both are anchors; the longest increasing subsequence of anchors is
kept, and the gaps between them are aligned in the same way, after what they have
in common at either end. The share of the template's words aligned is its coverage.

Only texts that could reach the coverage are aligned: the template's words that the
text has, counted with multiplicity, bound what any alignment can match. Within a
text, alignment is tried from every place where the template may begin, in windows
of the template's length first and then of wider ones, up to ``stretch`` times that
length (None: up to the whole text), so a text may hold a notice several times, and
one with other words in between. Words are lower-cased (ASCII) without marks at
their ends.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as T
from .toxicity import _TRIM

COVERAGE = 0.8
#: A match spans at most so many times the template's words: what is strewn over
#: more text than that isn't called a notice.
STRETCH = 3.0

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "reserved": "All rights reserved.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    "EPL-1.0-title": "Eclipse Public License - v 1.0",
    "EPL-2.0-title": "Eclipse Public License - v 2.0",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-1.0-header": """All rights reserved. This program and the accompanying materials are made available under the terms of the
        Eclipse Public License v1.0 which accompanies this distribution, and is available at
        http://www.eclipse.org/legal/epl-v10.html""",
    "EPL-2.0-header": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
}

_GNU = """{this} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name}General Public
    License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any
    later version. {this} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for
    more details."""
for _name, _kind, _version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
    _this = "This library" if _name == "LGPL-2.1" else "This program"
    TEMPLATES[f"{_name}-header"] = _GNU.format(this=_this, colon=":" if _version == "3" else ";", name=_kind, version=_version)
for _name, _rest in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC", "-NonCommercial"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
    TEMPLATES[f"CC-{_name}-4.0-notice"] = f"This work is licensed under a Creative Commons Attribution{_rest} 4.0 International License."
for _id in """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause
    BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0
    CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only
    GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only
    LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0
    OFL-1.1 OSL-3.0 PSF-2.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 Vim WTFPL X11 Zlib ZPL-2.1""".split():
    TEMPLATES[f"SPDX:{_id}"] = f"SPDX-License-Identifier: {_id}"
#: Whole texts, one file each.
TEMPLATES |= {f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        in_b = {b[j]: j for j in range(b0, b1) if cb[b[j]] == 1}
        pairs = [(i, in_b[a[i]]) for i in range(a0, a1) if ca[a[i]] == 1 and a[i] in in_b]
        kept = _increasing(pairs)
        x, y = a0, b0
        for i, j in [*kept, (a1, b1)] if kept else []:
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        out += kept
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, ascending in the first, ascending in the second."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = at[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out: list[tuple[int, int]] = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of trimmed words, and word offsets of rows."""
    buf = T.lower_ascii(buf)
    s, e, woff = T.word_spans(buf, off)
    for _ in range(4):
        e = e - ((e - s > 1) & _TRIM[buf[e - 1]])
        s = s + ((e - s > 1) & _TRIM[buf[s]])
    return T.word_hashes(buf, s, e), woff


@cache
def _compiled(items: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, list[tuple[str, list[int], np.ndarray]]]:
    raw = [text.encode() for _, text in items]
    h, off = _words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    vocabulary = np.unique(h)
    code = np.searchsorted(vocabulary, h)
    out = []
    for (name, _), a, b in zip(items, off.tolist(), off[1:].tolist()):
        out.append((name, code[a:b].tolist(), np.bincount(code[a:b], minlength=len(vocabulary))))
    return vocabulary, out


def _spans(template: int, text: int, stretch: float | None) -> list[int]:
    """Widths of the windows that are aligned, ascending."""
    widest = text if stretch is None else min(text, int(max(1.0, stretch) * template))
    out = [min(template, widest)]
    while out[-1] < widest:
        out.append(min(widest, int(out[-1] * 1.5) + 1))
    return out


def _matches(words: list[int], template: list[int], need: int, stretch: float | None = STRETCH) -> list[tuple[int, int, int]]:
    """(first word, end, words matched) of the template's matches, not overlapping.
    ``words`` are codes, -1 for words no template has."""
    own = Counter(template)
    if sum(min(n, own[w]) for w, n in Counter(words).items() if w in own) < need:
        return []
    left, found = list(words), []
    spans = _spans(len(template), len(words), stretch)
    for k, span in enumerate(spans):
        new = _within(left, template, own, need, span, spans[k + 1 :])
        for first, end, _ in new:
            left[first:end] = [-1] * (end - first)
        found += new
    return sorted(found)


def _within(words: list[int], template: list[int], own: Counter, need: int, span: int, wider: list[int]) -> list[tuple[int, int, int]]:
    """Matches in windows of ``span`` words; a ``wider`` window from where one begins
    takes its place if more of the template is in it."""
    found: list[tuple[int, int, int]] = []
    last = 0
    have = dict.fromkeys(own, 0)  # of words[low:high]; bound is what of it the template has
    low = high = bound = 0
    skip = 0  # a window a few words on holds at most as many more of the template's
    for p in [i for i, w in enumerate(words) if w in own]:
        if p < last or p < skip and words[p] != template[0]:
            continue
        for w in words[high : p + span]:
            if w in own:
                have[w] += 1
                bound += have[w] <= own[w]
        for w in words[low:p]:
            if w in own:
                bound -= have[w] <= own[w]
                have[w] -= 1
        low, high = p, max(high, min(p + span, len(words)))
        if bound < need:
            continue
        pairs = align(words[p : p + span], template)
        # the window may begin before the notice does, or end after it
        if len(pairs) >= need:
            first = p + pairs[0][0]
            pairs = [(p + i - first, j) for i, j in pairs]
            for w in wider if len(pairs) < len(template) else []:
                pairs = max(pairs, align(words[first : first + w], template), key=len)
            first, end = first + pairs[0][0], first + pairs[-1][0] + 1
            found.append((first, end, len(pairs)))
            last = end
        elif span > len(template):
            skip = p + need - len(pairs)
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, stretch: float | None = STRETCH) -> DataFrame:
    """One row per notice found: doc_id, license, coverage, n_matched, start_word and
    end_word (of the text's words, end exclusive; a span may enclose foreign words). Null and empty texts have none;
    rows are independent, so any doc_id, repeated or null, passes through."""
    T.bounded_batches(docs.sparkSession)
    items = tuple((templates or TEMPLATES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, compiled = _compiled(items)
        for t in T.blocks(batches):
            h, woff = _words(*T.buffers(t.column("text")))
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            code = np.where(vocabulary[at] == h, at, -1)
            known = np.flatnonzero(code >= 0)
            row = np.searchsorted(woff, known, "right") - 1
            pair, count = np.unique(row * len(vocabulary) + code[known], return_counts=True)
            row, word = pair // len(vocabulary), pair % len(vocabulary)
            by_word = np.argsort(word, kind="stable")
            row, word, count = row[by_word], word[by_word], count[by_word]
            first = np.searchsorted(word, np.arange(len(vocabulary) + 1))
            ids = t.column("doc_id").to_pylist()
            rows = []
            for name, template, has in compiled:
                need = max(1, int(np.ceil(coverage * len(template) - 1e-9)))
                part = np.concatenate([np.arange(first[w], first[w + 1]) for w in np.flatnonzero(has).tolist()])
                bound = np.bincount(row[part], np.minimum(count[part], has[word[part]]), t.num_rows)
                for i in np.flatnonzero(bound >= need).tolist():
                    for a, b, n in _matches(code[woff[i] : woff[i + 1]].tolist(), template, need, stretch):
                        rows.append((ids[i], name, n / len(template), n, a, b))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "coverage", "n_matched", "start_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, n_matched long, start_word long, end_word long")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(T.table(spark, sf_dir, "documents"))
