"""Operator 8: licence scans.

1. A file's lines, its paragraphs and its whole text become sparse vectors of their words: count times inverse frequency
   over the templates, where a word that no template has weighs as much as the rarest. A paragraph is lines up to a blank
   one, without comment marks, so a statement may go over line ends. The cosine to each template is taken; the best from
   THRESHOLD up is the licence that the line, paragraph or text states. Templates are notices, SPDX identifiers, and
   what licence files say.
2. A file's own licence is its best statement, ties by licence name; where the whole text is a licence file's, that is its
   licence. A file is a licence file if it states a licence and has a licence file's name, or if its whole text is a
   licence file's, or if statements hold at least MOSTLY of its words and its name hasn't the ending of a program's
   source: a header never licenses the directory of its file.
3. A file without a licence of its own takes that of the nearest directory above it that has a licence file: its distinct
   directories are put beside all their ancestors, joined to the directories with licence files, and the deepest wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, written
from .toxicity import SPACED

THRESHOLD, MOSTLY = 0.7, 0.5
#: Names of licence files, in lower case, without an ending, and the endings of files that can be one by what they say.
NAMES = ("license", "licence", "copying", "unlicense")
PROSE = ("", "txt", "md", "rst", "text", "markdown", "license", "licence")
#: What a line of a comment can begin and end with.
MARKS = re.compile(r"^[\s/*#;%!.'\"<>-]+|[\s*/>-]+$")
#: The licences' SPDX identifiers.
IDENTIFIERS = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
#: Customary notices.
NOTICES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
]
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NO_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_FSF = " Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
#: What licence files say, or how those of several pages begin.
FILES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc." + _FSF),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", _REDISTRIBUTION + _AS_IS),
    ("BSD-3-Clause", _REDISTRIBUTION + _NO_ENDORSEMENT + _AS_IS),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc." + _FSF),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc." + _FSF),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc." + _FSF),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc." + _FSF),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_REST),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
TEMPLATES = NOTICES + [(x, f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS] + FILES
#: How many words of a text are held against the beginnings of licence files.
HEAD = 60


def words_of(text: str) -> list[str]:
    return text.lower().encode("utf-8", "replace").translate(SPACED).decode().split()


class Matcher:
    """Cosines of texts to the templates."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, files: int = len(FILES)):
        """files: how many of the last templates are licence files."""
        self.first_file = len(templates) - files
        self.names = [n for n, _ in templates]
        bags = [words_of(t) for _, t in templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
        n = len(bags)
        df = np.zeros(len(self.vocabulary) + 1)
        for b in bags:
            df[[self.vocabulary[w] for w in set(b)]] += 1
        self.weight = np.log((1 + n) / (1 + df)) + 1  # the last is of every unknown word
        rows = np.zeros((len(self.vocabulary) + 1, n))
        for j, b in enumerate(bags):
            for w in b:
                rows[self.vocabulary[w], j] += 1
        rows *= self.weight[:, None]
        self.rows = rows / np.linalg.norm(rows, axis=0)

    def best(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """(licence or None, cosine, words) of each text."""
        cosine, words = self.cosines(texts)
        top = cosine.argmax(1)  # of equal cosines the first template
        best = cosine[np.arange(len(texts)), top]
        return [self.names[j] if c >= THRESHOLD else None for j, c in zip(top, np.round(best, 9), strict=True)], best, words

    def file(self, texts: list[str]) -> list[tuple[float, str] | None]:
        """(cosine, licence) of each text that is a licence file's, or begins as one."""
        heads = [" ".join(t.split(None, HEAD)[:HEAD]) for t in texts]
        found: list[tuple[float, str] | None] = [None] * len(texts)
        if self.first_file < len(self.names):
            for some in (texts, heads):
                cosine = np.round(self.cosines(some)[0][:, self.first_file :], 9)
                top = cosine.argmax(1)
                for i in np.flatnonzero(cosine[np.arange(len(some)), top] >= THRESHOLD):
                    found[i] = max(found[i] or (0.0, ""), (float(cosine[i, top[i]]), self.names[self.first_file + top[i]]))
        return found

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cosine of each text to each template, words of each text)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        raw = [t.lower().encode("utf-8", "replace").translate(SPACED) for t in texts]
        parts = pc.split_pattern(pa.array(raw, pa.large_binary()).cast(pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = coded.indices.to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        row = np.fromiter((self.vocabulary.get(w, len(self.vocabulary)) for w in distinct), np.int64, len(distinct))
        real = np.fromiter(map(bool, distinct), bool, len(distinct))[index]
        text, index = text[real], index[real]
        pair, count = np.unique(text * max(len(distinct), 1) + index, return_counts=True)
        text, row = pair // max(len(distinct), 1), row[pair % max(len(distinct), 1)]
        weight = count * self.weight[row]
        norm = np.sqrt(np.bincount(text, weight * weight, len(texts)))
        known = row < len(self.vocabulary)
        dot = np.zeros((len(texts), len(self.names)))
        np.add.at(dot, text[known], weight[known, None] * self.rows[row[known]])
        cosine = dot / np.maximum(norm, 1e-300)[:, None]
        return cosine, np.bincount(text, count, len(texts)).astype(np.int64)


def paragraphs(text: str) -> list[tuple[str, int]]:
    """(text, lines) of the paragraphs of several lines: what stands between blank lines, without comment marks."""
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        if line := MARKS.sub("", line):
            run.append(line)
        else:
            if len(run) > 1:
                out.append((" ".join(run), len(run)))
            run = []
    return out


def statements(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, n_files: int = len(FILES)) -> DataFrame:
    """files (path, text) -> path, own_license, similarity, n_statements, share: the words of statements by all words, is_text:
    whether the text is a licence file's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(templates, n_files)
        for pdf in batches:
            texts = pdf["text"].tolist()
            n = len(texts)
            lines, of, parts, part_of = [], [], [], []
            for i, t in enumerate(texts):
                own = t.split("\n")
                lines += own
                of += [i] * len(own)
                if len(own) > 1:
                    some = [x for x, _ in paragraphs(t)]
                    parts += some
                    part_of += [i] * len(some)
            best: list[tuple[float, str] | None] = [None] * n
            found, stated = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for units, owner in ((lines, of), (parts, part_of)):
                held = np.zeros(n, np.int64)
                for i, name, c, k in zip(owner, *matcher.best(units), strict=True):
                    if name:
                        found[i] += 1
                        held[i] += k
                        best[i] = min((-c, name), best[i] or (0.0, ""))
                stated = np.maximum(stated, held)
            whole_name, whole_cosine, words = matcher.best(texts)
            whole = matcher.file(texts)
            for i, (name, c) in enumerate(zip(whole_name, whole_cosine, strict=True)):
                if name:
                    stated[i] = words[i]
                    best[i] = min((-c, name), best[i] or (0.0, ""))
                if whole[i]:
                    best[i] = (-whole[i][0], whole[i][1])
            yield pd.DataFrame({"path": pdf["path"], "own_license": [b and b[1] for b in best], "similarity": [b and round(-b[0], 6) for b in best], "n_statements": found, "share": stated / np.maximum(words, 1), "is_text": [w is not None for w in whole]})

    bounded_batches(files.sparkSession)
    rows = files.select(F.col("path").cast("string").alias("path"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "path string, own_license string, similarity double, n_statements long, share double, is_text boolean")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, n_files: int = len(FILES)) -> DataFrame:
    """path, own_license, similarity, n_statements, is_license_file, license, inherited_from of every file.

    inherited_from: the directory that the licence comes from, '' for the top, null where it is the file's own or there is
    none. Of several licence files of a directory the one of highest similarity counts, then the smallest path. Defined
    results: null and empty texts state nothing; a null path has no directory and inherits nothing; rows of one path are
    scanned each; an empty table gives no rows; other columns are not read.
    """
    found = statements(files, templates, n_files)
    file = F.lower(F.element_at(F.split("path", "/"), -1))
    name, ending = F.regexp_replace(file, r"\.[^.]*$", ""), F.regexp_extract(file, r"\.([^.]*)$", 1)
    prose = F.coalesce(ending.isin(*PROSE), F.lit(True))
    file = F.coalesce(name.isin(*NAMES), F.lit(False)) | F.col("is_text") & prose | (F.col("share") >= MOSTLY) & prose
    found = found.withColumn("is_license_file", F.col("own_license").isNotNull() & file).drop("share", "is_text")
    found = written(found.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")), "statements")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "path", "own_license"))
    given = found.where("is_license_file and dir is not null").groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("above"), F.col("b.own_license").alias("given"))
    dirs = found.where("own_license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = dirs.select("dir", F.posexplode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), above))).alias("depth", "above"))
    near = above.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("n"))
    near = near.select("dir", F.col("n.above").alias("above"), F.col("n.given").alias("given"))
    out = found.join(near, "dir", "left")
    bare = F.col("own_license").isNull()
    return out.select("path", "own_license", "similarity", "n_statements", "is_license_file", F.coalesce("own_license", F.when(bare, F.col("given"))).alias("license"), F.when(bare, F.col("above")).alias("inherited_from"))
