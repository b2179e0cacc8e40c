"""License scans: passages against license templates by the Dice coefficient of their word bigrams.

Text is normalised to lower-cased words of letters and digits.  A passage is a line, a paragraph
(lines without an empty one between them) or the whole text.  For a passage of n distinct bigrams and
a template of m, Dice is 2 * common / (n + m); at least `least` of it needs n between
m * least / (2 - least) and m * (2 - least) / least, so only templates within these bounds are
candidates, and only passages that hold some template's bigram are looked at.  Common bigrams
of all passages of a block and all templates are counted at once.

With inside, passages within longer lines and paragraphs are found as well: runs of words that begin
with a bigram of the template, are as long as it or shorter, and end with one.  Only places where as
many of the template's bigrams as it needs stand within its length are looked at; of overlapping
runs the one of highest Dice counts, and none that overlaps a line, paragraph or text that
matches the same license.

Templates are a parameter: texts by license name, such as full license texts from a list of them.  Those
given here are the full short licenses and the notices of the long ones.

Defined cases: null or empty text and passages of fewer than two words match nothing; a template
found in several passages counts once per passage (equal passages at several levels once);
ties for the best match go to the template named first in the alphabet; repeated rows are scanned
each; an empty table gives an empty table.  Columns pass through; a column named matches is
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

LEAST = 0.8
LEVELS = ("line", "paragraph", "document", "passage")

# Notices and texts of common licenses, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
MATCH = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("level", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))


class Templates:
    """Distinct bigrams of every template: which bigram is in which, sizes, and size bounds."""

    def __init__(self, texts: dict[str, list[str]], least: float):
        self.names = [name for name in sorted(texts) for _ in texts[name]]
        words = c.Words([t.encode() for name in sorted(texts) for t in texts[name]], kind=c.ALNUM, lower=True)
        at, code = words.windows(2)
        owner = words.doc_of()[at]
        #: Bigrams of each template, repeated ones too.
        self.length = np.bincount(owner, minlength=len(self.names))
        self.bigrams = np.unique(code)
        self.holds = np.zeros((len(self.bigrams), len(self.names)), np.int64)
        self.holds[np.searchsorted(self.bigrams, code), owner] = 1
        self.sizes = self.holds.sum(0)
        self.low = np.ceil(self.sizes * least / (2 - least) - 1e-9)
        self.high = np.floor(self.sizes * (2 - least) / least + 1e-9)
        self.least = least


def _passages(words: c.Words) -> dict[str, np.ndarray]:
    """For each level, the passage that each word is in (numbers that grow with the words)."""
    buf = np.frombuffer(words.data, np.uint8)
    feeds = np.flatnonzero(buf == 10)
    line = np.searchsorted(feeds, words.starts)
    doc = words.doc_of()
    filled = np.unique(line)
    # A paragraph starts at a line whose line before is empty or in another document.
    first_doc = doc[np.searchsorted(line, filled)] if len(filled) else filled
    new = np.ones(len(filled), bool)
    new[1:] = (np.diff(filled) > 1) | (np.diff(first_doc) > 0)
    return {"line": line, "paragraph": np.cumsum(new)[np.searchsorted(filled, line)], "document": doc}


def _inside(words: c.Words, at: np.ndarray, code: np.ndarray, known: np.ndarray, templates: Templates, found: dict[int, list[dict]]) -> None:
    """Adds runs of words within lines and paragraphs that match a template and overlap no match of the same license."""
    doc = words.doc_of()
    #: Words of the block that a match of a license holds.
    taken: dict[str, np.ndarray] = {}
    for d, own in found.items():
        for m in own:
            start = int(words.first[d]) + m["first_word"]
            taken.setdefault(m["license"], np.zeros(len(doc), bool))[start : start + m["n_words"]] = True
    for t in np.argsort(-templates.length, kind="stable").tolist():  # a whole license before an excerpt of it
        name = templates.names[t]
        held = taken.setdefault(name, np.zeros(len(doc), bool))
        spot = np.flatnonzero((known >= 0) & (templates.holds[np.maximum(known, 0), t] == 1))
        need, length = int(templates.low[t]), int(templates.length[t])
        if len(spot) < need or not need:
            continue
        # Starts from which enough of the template's bigrams follow within its length, in one document.
        last = spot[need - 1 :]
        first = spot[: len(last)]
        first = first[(at[last] - at[first] < length) & (doc[at[last]] == doc[at[first]])]
        first = first[~held[at[first]]]  # a run that begins in a match overlaps it
        ends = np.searchsorted(at, np.minimum(at[first] + length, words.first[doc[at[first]] + 1] - 1))
        lasts = spot[np.searchsorted(spot, ends) - 1]
        runs, scores = [], {}
        for i, j, start, stop in zip(first.tolist(), lasts.tolist(), at[first].tolist(), (at[lasts] + 2).tolist(), strict=True):
            run = code[i : j + 1]
            dice = scores.get(key := run.tobytes())
            if dice is None:  # equal runs are scored once
                own = run[templates.holds[np.maximum(known[i : j + 1], 0), t] * (known[i : j + 1] >= 0) == 1]
                dice = scores[key] = float(2 * len(np.unique(own)) / (len(np.unique(run)) + templates.sizes[t]))
            if dice >= templates.least:
                runs.append((-dice, start, stop))
        for dice, start, stop in sorted(runs):
            if not held[start:stop].any():
                held[start:stop] = True
                d = int(doc[start])
                found.setdefault(d, []).append({"license": name, "dice": -dice, "level": "passage", "first_word": start - int(words.first[d]), "n_words": stop - start})


def matches(raw: list[bytes], templates: Templates, inside: bool = False) -> dict[int, list[dict]]:
    """For each text of a block that holds a license: its matching passages."""
    words = c.Words(raw, kind=c.ALNUM, lower=True)
    at, code = words.windows(2)
    found: dict[int, list[dict]] = {}
    if not len(at):
        return found
    known = np.minimum(np.searchsorted(templates.bigrams, code), len(templates.bigrams) - 1)
    is_known = templates.bigrams[known] == code
    doc = words.doc_of()
    seen = set()
    for level, passage in _passages(words).items():
        whole = passage[at] == passage[at + 1]
        hit = is_known & whole
        some = np.unique(passage[at[hit]])
        if not len(some):
            continue
        # Distinct bigrams of the passages that hold a template's bigram.
        mine = np.flatnonzero(whole & np.isin(passage[at], some))
        number = np.searchsorted(some, passage[at[mine]])
        order = np.lexsort((code[mine], number))
        number, mine = number[order], mine[order]
        new = np.ones(len(mine), bool)
        new[1:] = (number[1:] != number[:-1]) | (code[mine][1:] != code[mine][:-1])
        number, mine = number[new], mine[new]
        size = np.bincount(number, minlength=len(some))
        k = is_known[mine]
        for t, name in enumerate(templates.names):
            fits = (size >= templates.low[t]) & (size <= templates.high[t])
            if not fits.any():
                continue
            common = np.bincount(number[k], templates.holds[known[mine[k]], t], len(some))
            dice = 2 * common / (size + templates.sizes[t])
            like = np.flatnonzero(fits & (dice >= templates.least))
            begin, end = np.searchsorted(passage, some[like]), np.searchsorted(passage, some[like] + 1)
            owner = doc[begin]
            for d, x, y, first, score in zip(owner.tolist(), begin.tolist(), end.tolist(), words.first[owner].tolist(), dice[like].tolist(), strict=True):
                key = (d, name, x, y)
                if key not in seen:
                    seen.add(key)
                    found.setdefault(d, []).append({"license": name, "dice": score, "level": level, "first_word": x - first, "n_words": y - x})
    if inside:
        _inside(words, at, code, np.where(is_known, known, -1), templates, found)
    return found


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, inside: bool = False) -> DataFrame:
    """docs with matches: (license, dice, level, first_word, n_words) of every passage that is like a template."""
    own = Templates(templates or TEMPLATES, least)
    docs = docs.drop("matches")
    c.small_batches(docs.sparkSession)

    def run(batches):
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("level", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        for part, raw in c.blocks(batches):
            found = matches(raw, own, inside)
            columns = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            yield pa.RecordBatch.from_pydict(columns | {"matches": pa.array([found.get(i, []) for i in range(len(raw))], kind)})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("matches", MATCH)]))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, inside=True)
    best = F.element_at(F.array_sort("matches", lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0)), 1)
    best = F.when(F.size("matches") > 0, best)
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.size("matches").cast("long").alias("n_passages"),
        best["license"].alias("best_license"),
        best["dice"].alias("best_dice"),
    )
