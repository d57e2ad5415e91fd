import math
import textwrap
from collections import Counter

import pytest

from shardflow.llm.licences import FULL, TEMPLATES, VOCABULARY, Templates, frequencies, licences, terms
from shardflow.llm.queries import queries
from tests.conftest import SMALL
from tests.llm import cases

KIND = "doc_id bigint, text string, path string"
MIT = "Released under the MIT License.\n"
GPL = "// SPDX-License-Identifier: GPL-3.0-or-later\n"


def run(spark, rows):
    return {r["doc_id"]: r for r in licences(spark.createDataFrame(rows, KIND).repartition(3)).collect()}


def brute_best(n, df, words):
    idf = lambda t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 if t in set(VOCABULARY) else math.log(1 + n) + 1
    vector = lambda ws: {t: (1 + math.log(k)) * idf(t) for t, k in Counter(ws).items()}
    x = vector(words)
    best = (0.0, None)
    for name, texts in TEMPLATES.items():
        for text in texts:
            y = vector(terms(text))
            dot = sum(v * y.get(t, 0) for t, v in x.items())
            c = dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
            if c > best[0] + 1e-9:
                best = (c, name)
    return best


def test_cosine():
    df = {t: i % 7 for i, t in enumerate(VOCABULARY)}
    templates = Templates(50, df)
    for line in ("Licensed under the Apache License, Version 2.0", "released under the MIT license (see file)", "all rights reserved", "nothing of note", ""):
        score, name = templates.best(terms(line))
        want = brute_best(50, df, terms(line)) if terms(line) else (0.0, None)
        assert (name, score) == (want[1], pytest.approx(want[0]))


def test_headers_and_licence_files(spark):
    prose = cases.prose(100, 3)
    rows = [(1, MIT + prose, "a/LICENSE.txt"), (2, f"{prose}\n{GPL}{prose}", "a/b.c"), (3, prose, "a/c.c"), (4, "Licensed under the Apache\nLicense, Version 2.0 (the", "x"), (5, "We talked about a license for the shop today and the mayor said no.", "y/z")]
    got = run(spark, rows)
    assert [got[i]["licence"] for i in (1, 2, 3, 4, 5)] == ["MIT", "GPL-3.0", None, "Apache-2.0", None]
    assert got[1]["is_licence_file"] and not got[2]["is_licence_file"]
    assert (got[3]["inherited_licence"], got[3]["inherited_from"]) == ("MIT", "a")
    assert got[2]["inherited_licence"] is None


def brute_inherit(files, path):
    """The nearest directory at or above that has a file."""
    parts = [x for x in path.rpartition("/")[0].split("/") if x]
    for k in range(len(parts), -1, -1):
        d = "/".join(parts[:k])
        if d in files:
            return files[d], d
    return None, None


def test_nearest_ancestor(spark):
    prose = cases.prose(60, 4)
    files = {"": "MIT", "a/b": "GPL-3.0", "a/b/c/d": "MIT"}
    rows = [(i, MIT if n == "MIT" else GPL, f"{d}/LICENSE".lstrip("/")) for i, (d, n) in enumerate(files.items())]
    paths = ["top", "a/x", "a/b/x", "a/bc/x", "a/b/c/x", "a/b/c/d/x", "a/b/c/d/e/f/x", "other/deep/down/x"]
    rows += [(100 + i, prose, p) for i, p in enumerate(paths)]
    got = run(spark, rows)
    for i, p in enumerate(paths):
        r = got[100 + i]
        assert (r["inherited_licence"], r["inherited_from"]) == brute_inherit(files, p), p


def test_odd_paths_and_nulls(spark):
    rows = [(1, MIT, "LICENSE"), (2, "x", None), (3, None, "d/x"), (None, "", ""), (4, MIT, None), (5, "x", "/abs//x"), (5, "x", "/abs//x"), (6, "x" * 100_000, "d/")]
    out = licences(spark.createDataFrame(rows, KIND)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[2]["inherited_licence"] is None and by[4]["licence"] == "MIT"
    assert by[3]["inherited_licence"] == "MIT" == by[5]["inherited_licence"] == by[6]["inherited_licence"] and by[3]["inherited_from"] == ""


def test_absolute_and_doubled_slashes(spark):
    rows = [(1, MIT, "/a//b/LICENSE"), (2, "x", "/a/b/c/x"), (3, "x", "a/b//x"), (4, "x", "/a/x"), (5, GPL, "r//LICENSE"), (6, "x", "r/x")]
    got = run(spark, rows)
    assert [(got[i]["inherited_licence"], got[i]["inherited_from"]) for i in (2, 3, 4, 6)] == [("MIT", "a/b"), ("MIT", "a/b"), (None, None), ("GPL-3.0", "r")]


def test_several_licence_files_of_a_directory(spark):
    """The highest cosine counts, then the first path."""
    rows = [(1, MIT, "d/LICENSE.b"), (2, MIT, "d/LICENSE.a"), (3, "Licensed under the GNU Lesser General Public License", "d/COPYING"), (4, "plain", "d/f")]
    got = run(spark, rows)
    best = max((1, 2, 3), key=lambda i: (got[i]["score"] if got[i]["licence"] else -1, -i))
    assert got[4]["inherited_licence"] == got[best]["licence"]


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries()["op10_licences"](spark, SMALL).collect()}
    assert got.keys() == docs.keys()
    names = {"Licensed under the Apache License": "Apache-2.0", "MIT License": "MIT", "SPDX-License-Identifier: GPL-3.0": "GPL-3.0", "SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0"}
    seen = 0
    for i, text in docs.items():
        named = {n for cue, n in names.items() if cue in (text or "")}
        if named:
            seen += 1
            assert got[i]["licence"] is not None
    assert seen and sum(r["licence"] is not None for r in got.values()) < len(got) / 2
    files = {r["path"].rpartition("/")[0] for r in got.values() if r["is_licence_file"]}
    for r in got.values():
        if r["licence"] is None:
            assert r["inherited_from"] == brute_inherit({d: d for d in files}, r["path"])[1]


def test_notices_inside_longer_lines_and_blocks(spark):
    prose = " ".join(cases.prose(300, 8).split())
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    mit = "\n".join(f" * {x}" for x in textwrap.wrap(FULL["MIT"], 60))
    want = {
        "This file is licensed under the MIT License.": "MIT",
        "Copyright 2020 Example Corp. Licensed under the MIT License.": "MIT",
        apache: "Apache-2.0",
        f"{prose} {apache} {prose}": "Apache-2.0",
        f"{prose}\n// licensed under\n// the GNU General\n// Public License\n// version 2\n{prose}": "GPL-2.0",
        mit: "MIT",
        f"Copyright (c) 2020, X. All rights reserved.\n\n{FULL['BSD-2-Clause']}": "BSD-2-Clause",
        f"Copyright (c) 2020, X. All rights reserved.\n\n{FULL['BSD-3-Clause']}": "BSD-3-Clause",
        FULL["ISC"]: "ISC",
        "Copyright (c) 2020 X. All rights reserved.": "Proprietary",
        f"{prose} Apache License. Copyright (c) {prose}": None,
        f"{prose} released under the new license today {prose}": None,
    }
    got = run(spark, [(i, t, f"d{i}/x.c") for i, t in enumerate(want)] + [(100 + i, prose, "p") for i in range(30)])
    assert [got[i]["licence"] for i in range(len(want))] == list(want.values())
    assert got[5]["is_licence_file"] and got[8]["is_licence_file"] and not got[3]["is_licence_file"]


def test_whole_files_by_brute_force():
    """Every text against every whole licence, whatever words it has; the bound skips none that is near."""
    df = {t: (i * i) % 40 for i, t in enumerate(VOCABULARY)}
    templates = Templates(50, df, 1)
    texts = [terms(x) for x in FULL.values()]
    texts += [t[: len(t) * k // 10] for t in texts[:] for k in (3, 5, 7, 9)] + [t + terms(cases.prose(n, n)) for t in texts[:7] for n in (5, 40, 200)]
    texts += [sorted(texts[0]), texts[0] * 3, [], ["software"], terms(cases.prose(300, 5))]
    hits = 0
    for words in texts:
        v = templates.vector(words)
        want = {name: sum(x * y.get(t, 0.0) for t, x in v.items()) for name, _, y in templates.full}
        score, name = templates.whole(words)
        if max(want.values()) < 0.7:
            assert (score, name) == (0.0, None)
        else:
            hits += 1
            assert score == pytest.approx(max(want.values())) and want[name] == pytest.approx(max(want.values()))
    assert hits > 20


def test_whole_files_without_names(spark):
    """A file that holds the whole text of a licence is a licence file whatever its name and its lines."""
    other = {f"{k}/notes": " ".join(FULL[k].split()) for k in FULL}
    got = run(spark, [(i, f"Copyright 2020 Someone\n\n{t}", p) for i, (p, t) in enumerate(other.items())] + [(100 + i, "plain text", f"{k}/sub/file") for i, k in enumerate(FULL)])
    for i, k in enumerate(FULL):
        assert got[i]["licence"] == k and got[i]["is_licence_file"], k
        assert got[100 + i]["inherited_licence"] == k and got[100 + i]["inherited_from"] == k


def test_frequencies_of_all_words(spark):
    docs = cases.of(spark, {1: "file license", 2: "File, other", 3: "file far", 4: None, 5: "license other"})
    n, df = frequencies(docs, "text")
    assert (n, df["file"], df["other"], df["license"]) == (5, 3, 2, 2)
    assert "far" not in df and df["redistribution"] == 0


def test_empty_and_clashes(spark):
    none = spark.createDataFrame([], KIND)
    assert cases.rows(licences(none)) == []
    df = spark.createDataFrame([(1, MIT, "a/LICENSE"), (2, "x", "a/b")], KIND)
    cases.same_with_clashes(df, licences)
