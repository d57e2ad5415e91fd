"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import keep, numbered, on_batches

#: Bags of words of notices, several for a licence: the order of words doesn't count.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["licensed under the apache license version 2.0", "spdx-license-identifier apache-2.0", "apache license version 2.0 january 2004 terms and conditions for use reproduction and distribution"],
    "MIT": ["released under the mit license", "licensed under the mit license", "mit license copyright c", "spdx-license-identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "spdx-license-identifier gpl-3.0-or-later", "gnu general public license version 3 29 june 2007", "licensed under gpl v3"],
    "GPL-2.0": ["licensed under the gnu general public license version 2", "spdx-license-identifier gpl-2.0-only", "gnu general public license version 2 june 1991", "licensed under gpl v2"],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "spdx-license-identifier lgpl-3.0-or-later"],
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "spdx-license-identifier agpl-3.0-or-later"],
    "BSD-3-Clause": ["licensed under the bsd 3-clause license", "spdx-license-identifier bsd-3-clause", "redistribution and use in source and binary forms neither the name of contributors"],
    "BSD-2-Clause": ["licensed under the bsd 2-clause license", "spdx-license-identifier bsd-2-clause"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "spdx-license-identifier mpl-2.0"],
    "ISC": ["released under the isc license", "spdx-license-identifier isc"],
    "CC0-1.0": ["licensed under cc0 1.0 universal public domain dedication", "spdx-license-identifier cc0-1.0"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx-license-identifier cc-by-4.0"],
    "CC-BY-SA-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "spdx-license-identifier cc-by-sa-4.0"],
    "CC-BY-NC-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "spdx-license-identifier cc-by-nc-4.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "spdx-license-identifier unlicense"],
    "Proprietary": ["all rights reserved", "copyright c all rights reserved", "proprietary and confidential unauthorized copying is strictly prohibited"],
}
#: Whole texts of short licences, without their titles and copyright lines.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_FREE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
FULL: dict[str, str] = {"MIT": _MIT, "BSD-3-Clause": _BSD + _NAMES + _AS_IS, "BSD-2-Clause": _BSD + _AS_IS, "ISC": _ISC, "0BSD": _0BSD, "Zlib": _ZLIB, "Unlicense": _FREE}
#: A text is compared around each word that has one of these; every template has such a word.
CUES = ("licen", "copyright", "reserved", "spdx", "domain", "hereby", "redistribution", "proprietary")
#: Words at which a whole text of FULL begins.
BEGINS = ("permission", "redistribution")
#: Least cosine of a header.
LEAST = 0.7
#: A file is a licence file if it has a licence and is named so, if headers are this part of its words, or if as a whole it
#: is near (LEAST) to the whole text of a licence.
SHARE = 0.5
NAMES = ("license", "licence", "copying", "unlicense")
_EDGE = ".,;:!?\"'()[]{}<>|*#%&$~_=+/\\`©-"


def terms(line: str) -> list[str]:
    """Lower-case words without punctuation at their edges."""
    return [t for t in (w.strip(_EDGE) for w in line.lower().split()) if t]


VOCABULARY = sorted({t for v in [*TEMPLATES.values(), [*FULL.values()]] for x in v for t in terms(x)})
#: Words before and behind a cue that a window can have: some more than the longest template.
REACH = max(len(terms(x)) for v in TEMPLATES.values() for x in v) + 4
#: Words of the longest whole text.
LONGEST = max(len(terms(x)) for x in FULL.values())
#: Distinct words that a task counts before it gives them on.
_HELD = 200_000


def cued(words: list[str]) -> list[int]:
    return [i for i, t in enumerate(words) if any(c in t for c in CUES)]


def near(words: list[str]) -> set[str]:
    """The words that are compared with templates."""
    found = set()
    for p in cued(words):
        found.update(words[max(0, p - REACH) : p + REACH + 1])
    for p, t in enumerate(words):
        if t in BEGINS:
            found.update(words[p : p + LONGEST])
    return found


def frequencies(docs: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """How many documents there are, and in how many each word is. All words of all documents are counted; the driver gets
    those of the templates and of the stretches that are compared with them, if more than one document has them."""
    fixed = set(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, close = Counter(), set()

        def rows() -> pa.RecordBatch:
            ws = list(counts)
            cols = [pa.array(ws, pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([w in close for w in ws], pa.bool_())]
            return pa.RecordBatch.from_arrays(cols, ["term", "n", "near"])

        for b in batches:
            for x in b.column(0):
                low = (x.as_py() or "").lower()
                words = {w.strip(_EDGE) for w in set(low.split())}
                words.add("")  # stands for the documents
                counts.update(words)
                if any(c in low for c in (*CUES, *BEGINS)):
                    close |= near(terms(low))
                if len(counts) > _HELD:
                    yield rows()
                    counts, close = Counter(), set()
        yield rows()

    all_ = on_batches(docs.select(text), run, "term string, n bigint, near boolean").groupBy("term").agg(F.sum("n").alias("n"), F.max("near").alias("near"))
    got = {r["term"]: r["n"] for r in all_.where(F.col("term").isin("", *fixed) | (F.col("near") & (F.col("n") > 1))).select("term", "n").collect()}
    return got.pop("", 0), {t: 0 for t in fixed} | got


class Templates:
    """Sparse unit vectors of all templates, by word. Words without a frequency are in `unseen` documents."""

    def __init__(self, n: int, df: dict[str, int], unseen: int = 0):
        self.idf = {t: float(np.log((1 + n) / (1 + k)) + 1) for t, k in df.items()}
        self.rare = float(np.log((1 + n) / (1 + unseen)) + 1)
        self.names, self.by, self.telling, self.weak = [], {}, [], set()
        of = {name: {t for x in texts for t in terms(x)} for name, texts in TEMPLATES.items()}
        for name, texts in TEMPLATES.items():
            others = set().union(*(ws for k, ws in of.items() if k != name))
            for text in texts:
                v = self.vector(terms(text))
                for t, x in v.items():
                    self.by.setdefault(t, []).append((len(self.names), x))
                self.telling.append(v.keys() - others)
                if "reserved" in v:
                    self.weak.add(len(self.names))
                self.names.append(name)
        self.dense = {}
        for t, at in self.by.items():
            self.dense[t] = np.zeros(len(self.names))
            for i, x in at:
                self.dense[t][i] = x * self.idf.get(t, self.rare)
        self.none = np.zeros(len(self.names))
        self.full = [(name, len(terms(x)), self.vector(terms(x))) for name, x in FULL.items()]
        self.in_full = set().union(*(v for _, _, v in self.full))
        self.seen: dict[tuple, tuple | None] = {}

    def vector(self, words: list[str]) -> dict[str, float]:
        v = {t: (1 + math.log(k)) * self.idf.get(t, self.rare) for t, k in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def scores(self, words: list[str]) -> dict[int, float]:
        """Cosines by template."""
        out: dict[int, float] = {}
        for t, x in self.vector(words).items():
            for i, y in self.by.get(t, ()):
                out[i] = out.get(i, 0.0) + x * y
        return out

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """Cosine and licence of the nearest template; of equal ones the first listed."""
        scores = self.scores(words)
        if not scores:
            return 0.0, None
        at = min(scores, key=lambda i: (-round(scores[i], 9), i))
        return min(1.0, scores[at]), self.names[at]

    def window(self, words: list[str], p: int) -> tuple[int, int, float, str, bool] | None:
        """The window with word p that is nearest to a template, of all windows that reach REACH words before and behind it
        at most: start, end, cosine, licence, whether the template is a weak one. A template that has words which no other
        licence has counts only where the window has one of these."""
        lo = max(0, p - REACH)
        part, at = words[lo : p + REACH + 1], p - lo
        key = (at, *part)
        if key not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            self.seen[key] = self._window(part, at)
        got = self.seen[key]
        return got and (got[0] + lo, got[1] + lo, *got[2:])

    def _window(self, part: list[str], at: int) -> tuple[int, int, float, str, bool] | None:
        held = set(part)
        open_ = np.array([not t or not t.isdisjoint(held) for t in self.telling])
        last, before = {}, np.empty(len(part), int)
        for i, t in enumerate(part):
            before[i], last[t] = last.get(t, -1), i
        # No cosine is above this: repeated words count fully in the product and once in the norm.
        start, end = np.arange(at + 1), np.arange(at + 1, len(part) + 1)
        dots = np.concatenate([self.none[None], np.cumsum([self.dense.get(t, self.none) for t in part], 0)])
        square = np.array([self.idf.get(t, self.rare) ** 2 for t in part])
        inside = (np.arange(len(part)) >= start[:, None]) & (before < start[:, None])
        norms = np.sqrt(np.cumsum(np.where(inside, square, 0), 1)[:, end - 1])
        bound = ((dots[end][None] - dots[start][:, None]) * open_).max(2) / norms
        found, least = None, LEAST
        a, b = np.nonzero(bound >= LEAST - 1e-9)
        for i in np.argsort(-bound[a, b], kind="stable"):
            s, e = int(start[a[i]]), int(end[b[i]])
            if bound[a[i], b[i]] < least - 1e-9:
                break
            ws = part[s:e]
            for k, x in self.scores(ws).items():
                rank = (round(x, 9), k not in self.weak, -k)
                if x >= LEAST and (found is None or rank > found[0]) and (not self.telling[k] or not self.telling[k].isdisjoint(ws)):
                    found, least = (rank, s, e, min(1.0, x), self.names[k], k in self.weak), x
        return found and found[1:]

    def block(self, words: list[str], p: int) -> tuple[int, int, float, str, bool] | None:
        """As `window`: the nearest whole text that begins at word p."""
        found = None
        for name, n, y in self.full:
            x = sum(v * y.get(t, 0.0) for t, v in self.vector(words[p : p + n]).items())
            if x >= LEAST and (found is None or x > found[2]):
                found = (p, min(len(words), p + n), min(1.0, x), name, False)
        return found

    def whole(self, words: list[str]) -> tuple[float, str | None]:
        """As `best`: the nearest whole text of a licence to all words of a file. Most files fall by a bound: words that
        no licence has add at least 1 each to the square of the norm."""
        count = Counter(words)
        shared = count.keys() & self.in_full
        held = sum(((1 + math.log(count[t])) * self.idf.get(t, self.rare)) ** 2 for t in shared)
        if held < LEAST**2 * (held + len(count) - len(shared)) - 1e-9 or not shared:
            return 0.0, None
        v = self.vector(words)
        x, name = max(((sum(v[t] * y[t] for t in shared & y.keys()), name) for name, _, y in self.full), key=lambda r: round(r[0], 9))
        return (min(1.0, x), name) if x >= LEAST else (0.0, None)

    def scan(self, text: str) -> tuple[str | None, float, int, float]:
        """Licence, cosine, number of headers, and their part of the words. Headers are whole texts of short licences, and
        the windows around cues, wherever lines and sentences end, that are nearest to a template; those that overlap
        a better one don't count again; the text as a whole is held against whole licences, too. "All rights reserved" stands in front of licences too and names one only where no
        other header does."""
        low = text.lower()
        words = terms(low)
        near, of = self.whole(words)
        if not any(c in low for c in (*CUES, *BEGINS)):
            return of, near, int(near > 0), 1.0 if of else 0.0
        blocks = [f for p, t in enumerate(words) if t in BEGINS and (f := self.block(words, p))]
        windows = [f for p in cued(words) if (f := self.window(words, p))]
        taken, found = np.zeros(len(words), bool), []
        for some in (blocks, windows):
            for f in sorted(some, key=lambda f: (-f[2], f[0], f[1])):
                if not taken[f[0] : f[1]].any():
                    taken[f[0] : f[1]] = True
                    found.append(f)
        n = len(found)
        if of:
            found.append((0, len(words), near, of, False))
        if not found:
            return None, 0.0, 0, 0.0
        _, _, score, name, _ = max(found, key=lambda f: (not f[4], f[2], f[3]))
        return name, score, max(1, n), 1.0 if of else float(taken.sum()) / max(1, len(low.split()))


def _directory(path: Column) -> Column:
    """Names of the folders joined by single slashes, with none in front."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, r"[^/]*$", ""), "/"), lambda x: x != ""), "/")


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """doc_id, path, licence, score, n_headers, is_licence_file, inherited_licence, inherited_from for every row.

    Inverse document frequencies are counted over all words of all documents. Around every cue of the whole text windows are
    compared, across lines and sentences. A document without a licence of its own inherits from
    the nearest directory at or above its own that has a licence file (of several, the one with the highest cosine, then the
    first path). Directories, not documents, are joined with their ancestors; documents then join one row for
    each directory, a join that Spark splits where a directory is hot.

    Null texts have no licence; a null path has no directory and inherits nothing. Rows that repeat give equal
    rows; an empty table gives no rows; other columns are ignored.
    """
    plain, at, _ = numbered(docs, doc_id=id_col, text=text_col, path=path_col)
    base = plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), F.col(at["path"]).alias("path"))
    n, df = frequencies(base, "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "path", "licence", "score", "n_headers", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(n, df, 1)
        for b in batches:
            cols = list(zip(*(templates.scan(x.as_py() or "") for x in b.column(1)))) or [()] * 4
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    own = on_batches(base, run, f"doc_id {kind}, path string, licence string, score double, n_headers bigint, share double")
    stem = F.lower(F.regexp_extract(F.col("path"), r"([^/.]*)[^/]*$", 1))
    file = F.col("licence").isNotNull() & (stem.isin(*NAMES) | (F.col("share") >= SHARE))
    own = keep(own.withColumn("directory", _directory(F.col("path"))).withColumn("is_licence_file", F.coalesce(file, F.lit(False))), "licences")
    files = own.where("is_licence_file and directory is not null").groupBy("directory")
    files = files.agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("f")).select(F.col("directory").alias("above"), "f.licence")
    dirs = own.where("directory is not null").select("directory").distinct()
    parts = F.filter(F.split("directory", "/"), lambda x: x != "")  # none for the root
    level = F.explode(F.sequence(F.lit(0), F.size(parts))).alias("level")
    walk = dirs.select("directory", parts.alias("parts"), level)
    walk = walk.select("directory", "level", F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/").alias("above"))
    near = walk.join(files, "above").groupBy("directory").agg(F.max(F.struct("level", "above", "licence")).alias("n"))
    near = keep(near.select("directory", F.col("n.licence").alias("from_licence"), F.col("n.above").alias("from_directory")), "nearest")
    out = own.join(near, "directory", "left")
    none = F.col("licence").isNull()
    return out.select("doc_id", "path", "licence", "score", "n_headers", "is_licence_file", F.when(none, F.col("from_licence")).alias("inherited_licence"), F.when(none, F.col("from_directory")).alias("inherited_from"))
