"""Licence scans: normalised text held against licence templates by the Dice coefficient over word bigrams.

A text is normalised to its words (runs of ASCII letters and digits, in lower case, spellings such as "licence" made one).
What is held against a template are runs of words anywhere in the text, within a line or over many of them. The
coefficient of two multisets of bigrams is at most 2 * min / (min + max) of their sizes, so only runs within these bounds
count, and a template is pruned unless somewhere in the text enough of its bigrams stand close enough together to reach the
threshold. As a bigram that isn't the template's only lowers the score at an end of a run, a unit is, for each template and
each place of one of its bigrams, the best run from there that ends with one of them (the longest of equal ones).

Of units that overlap, the one with the higher score stays, then the longer, then the earlier one.

A line such as "All rights reserved." counts as a notice. Long licences are known by the notices that their stewards give
for use in works, not by their full texts; more templates can be passed.

Defined results: a null text counts as empty and has no licence; ties between templates go to the name that sorts first;
templates of less than two words match nothing; rows are judged one by one, so repeated rows get equal results and an
empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import core, texts

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

# Licence notices and statements as their stewards publish them. Several texts can stand for one licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the "
        "names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("All-Rights-Reserved", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."),
)

_WORD = re.compile(r"[a-z0-9]+")
_SAME = {"licence": "license", "licenced": "licensed", "licences": "licenses", "copyrights": "copyright"}


def lower(text: str) -> str:
    """The text with A to Z in lower case; every code point keeps its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[str]:
    return [_SAME.get(w, w) for w in _WORD.findall(lower(text))]


def bigrams(words: list[str]) -> Counter[tuple[str, ...]]:
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter([tuple(words)] if words else [])


def dice(a: Mapping, b: Mapping) -> float:
    """2 * common / (size + size), with repeats; 0 for two empty ones."""
    size = sum(a.values()) + sum(b.values())
    small, large = sorted((a, b), key=len)
    return 2 * sum(min(n, large.get(k, 0)) for k, n in small.items()) / size if size else 0.0


@dataclass(frozen=True)
class Match:
    licence: str
    score: float
    start: int
    end: int


class Scanner:
    """The templates as bigrams of numbered words."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.ratio = threshold / (2 - threshold)  # least ratio of the sizes of two units that reach the threshold
        made = sorted((name, words) for name, text in templates if len(words := words_of(text)) > 1)
        vocabulary = sorted({w for _, words in made for w in words})
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.number |= {w: self.number[same] for w, same in _SAME.items() if same in self.number}
        grams = sorted({g for _, words in made for g in zip(words, words[1:], strict=False)})
        self.gram = np.zeros((len(vocabulary) + 1) ** 2, np.int32)  # of two words the bigram's number; 0: in no template
        self.width = len(vocabulary) + 1
        place = {g: i + 1 for i, g in enumerate(grams)}
        for (a, b), i in place.items():
            self.gram[self.number[a] * self.width + self.number[b]] = i
        self.names = [name for name, _ in made]
        self.counts = [Counter(place[g] for g in zip(words, words[1:], strict=False)) for _, words in made]
        self.sizes = [len(words) - 1 for _, words in made]
        self.holds = np.zeros((len(made), len(grams) + 1), bool)
        for t, found in enumerate(self.counts):
            self.holds[t, list(found)] = True

    def scan(self, text: str) -> list[Match]:
        """Matches by start; none overlap."""
        low = lower(text)
        get = self.number.get
        words = np.array([get(w, 0) for w in _WORD.findall(low)], np.int64)
        if len(words) < 2:
            return []
        grams = self.gram[words[:-1] * self.width + words[1:]]
        at = np.flatnonzero(grams)
        if not len(at):
            return []
        own, found = grams[at], []
        for t, size in enumerate(self.sizes):
            if len(at) >= self.ratio * size:
                mine = self.holds[t, own]
                found += self._units(t, at[mine], own[mine])
        if not found:
            return []
        kept: list[tuple[int, int, str, float]] = []
        starts: list[int] = []
        for score, begin, end, name in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[1], f[3])):
            i = bisect_left(starts, begin)
            if (i == 0 or kept[i - 1][1] < begin) and (i == len(kept) or end < kept[i][0]):
                kept.insert(i, (begin, end, name, score))
                starts.insert(i, begin)
        spans = [m.span() for m in _WORD.finditer(low)]
        # a full stop right after a notice belongs to it
        return [Match(name, score, spans[a][0], (end := spans[b][1]) + (text[end : end + 1] == ".")) for a, b, name, score in kept]

    def _units(self, t: int, at: np.ndarray, own: np.ndarray) -> list[tuple[float, int, int, str]]:
        """(score, first word, last word, licence) of a template's units that reach the threshold. at: places of its bigrams, own: their numbers."""
        size, most, counts = self.sizes[t], self.sizes[t] / self.ratio + 1e-9, self.counts[t]
        need = int(np.ceil(self.ratio * size - 1e-9))  # bigrams in common, of any run that reaches the threshold
        if len(at) < need:
            return []
        out = []
        places, kinds = at.tolist(), own.tolist()
        for i in np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < most).tolist():
            left, common, best = dict(counts), 0, (0.0, 0)
            for j in range(i, len(places)):
                n = places[j] - places[i] + 1
                if n > most:
                    break
                if left[kinds[j]]:
                    left[kinds[j]] -= 1
                    common += 1
                best = max(best, (2 * common / (n + size), j))
            if best[0] >= self.threshold:
                out.append((best[0], places[i], places[best[1]] + 1, self.names[t]))
        return out


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: id, licences (distinct, sorted, comma-joined), n_matches, best_score (null: none), spans (licence:start:end in code points)."""
    rows, scanner = core(docs, id_col, text_col), Scanner(templates, threshold)
    schema = T.StructType(
        [rows.schema[id_col], T.StructField("licences", T.StringType()), T.StructField("n_matches", T.LongType()), T.StructField("best_score", T.DoubleType()), T.StructField("spans", T.StringType())]
    )

    def run(batches):
        for b in batches:
            found = [scanner.scan(x) for x in texts(b, text_col)]
            cols = [
                pa.array([",".join(sorted({m.licence for m in x})) for x in found], pa.string()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([round(max(m.score for m in x), 6) if x else None for x in found], pa.float64()),
                pa.array([",".join(f"{m.licence}:{m.start}:{m.end}" for m in x) for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)
