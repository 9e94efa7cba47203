import random

import pytest
from pyspark.sql import functions as F

from lumenlex.llm import licences as L

FILES = [
    (1, "a/b/x.py", "foo"), (2, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person"), (3, "a/b/c/y.py", "# SPDX-License-Identifier: Apache-2.0\ncode"),
    (4, "z.py", None), (5, None, ""), (6, "a/b/COPYING.txt", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), (7, "c/d", "he got his driving licence in 1990"), (8, "a/b/c/d/e.py", "bar"),
    (9, "a/q.py", "baz"), (10, "ab/q.py", "baz"), (1, "a/b/x.py", "foo"),
]


def test_headers_files_and_inheritance(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string").withColumns({c: F.lit(1) for c in ("licence", "score", "dir", "depth")})
    got = sorted((r["doc_id"], r["licence"], r["scope"], r["licence_path"]) for r in L.scan(df, F.col("path")).collect())
    assert got == [
        (1, "GPL-3.0", "inherited", "a/b/COPYING.txt"), (1, "GPL-3.0", "inherited", "a/b/COPYING.txt"), (2, "MIT", "own", "a/LICENSE"), (3, "Apache-2.0", "own", "a/b/c/y.py"), (4, None, "none", None),
        (5, None, "none", None), (6, "GPL-3.0", "own", "a/b/COPYING.txt"), (7, None, "none", None), (8, "GPL-3.0", "inherited", "a/b/COPYING.txt"), (9, "MIT", "inherited", "a/LICENSE"), (10, None, "none", None),
    ]
    assert L.scan(df.where("doc_id > 99"), F.col("path")).collect() == []


def test_notices_deep_in_long_texts():
    t = L.Templates()
    filler = "lorem ipsum dolor sit amet\n" * 20_000
    assert t.scan(filler + "Licensed under CC BY-NC 4.0.\n" + filler) == ("CC-BY-NC-4.0", 1.0)
    assert t.scan(filler) == (None, 0.0)
    assert t.scan("Released under the MIT License.")[0] == "MIT"
    assert t.scan("This work is licensed under the GNU General Public License, version 2.")[0] == "GPL-2.0"


def test_a_root_licence_is_inherited_by_all(spark):
    df = spark.createDataFrame([(0, "LICENSE", "Released under the MIT License."), *((i, f"p{i % 3}/f{i}", "x") for i in range(1, 50))], "doc_id long, path string, text string")
    assert {r["licence"] for r in L.scan(df, F.col("path")).collect()} == {"MIT"}


@pytest.mark.parametrize("most", [None, -1])
def test_inheritance_against_brute_force(spark, monkeypatch, most):
    """Root, absolute and deep directories, equal scores, repeated rows and NULL paths, each path walked up by itself."""
    if most is not None:  # as with tables too large to broadcast, and hot directories
        monkeypatch.setattr(L, "BROADCAST_BYTES", most)
        monkeypatch.setattr(L, "KEY_ROWS", 3)
    r = random.Random(4)
    texts = {"MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    names = ["a", "b", "", "c.d"]
    for trial in range(2):
        paths = ["/".join([*r.choices(names, k=r.randint(0, 5)), r.choice(["f", "g", "LICENSE", "copying.md"])]) for _ in range(150)]
        paths = [p for p in paths if trial or "/" in p.lstrip("/")] + [None, *paths[:5]]
        rows = [(i, p, texts[r.choice(list(texts))] if p and r.random() < 0.2 else "x") for i, p in enumerate(paths)]
        held: dict[str, list] = {}
        licence_of = {t: n for n, t in texts.items()}
        for _, p, t in rows:
            if p and t != "x" and p.rsplit("/", 1)[-1] in ("LICENSE", "copying.md"):
                held.setdefault(p.rsplit("/", 1)[0] if "/" in p else "", []).append((licence_of[t], p))
        want = []
        for i, p, t in rows:
            found = (licence_of[t], "own", p) if t != "x" else (None, "none", None)
            up = p
            while up and found[0] is None:
                up = up.rsplit("/", 1)[0] if "/" in up else ""
                if up in held:
                    licence, at = min(held[up])
                    found = (licence, "inherited", at)
            want.append((i, *found))
        df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({c: F.lit(1) for c in ("at", "from")})
        assert sorted((x["doc_id"], x["licence"], x["scope"], x["licence_path"]) for x in L.scan(df, F.col("path")).collect()) == want


def test_notices_amid_the_words_of_a_line():
    t = L.Templates()
    notices = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "SPDX-License-Identifier: ISC": "ISC"}
    for n in (5, 10, 40, 3000):
        filler = " ".join(f"lorem{'xyz'[i % 3]}" for i in range(n))
        for notice, name in notices.items():
            assert t.scan(f"{filler} {notice} {filler}") == (name, 1.0)
            assert t.scan(f"{filler} {notice.replace(' ', chr(10), 2)} {filler}") == (name, 1.0)
    assert t.scan(f"{filler}. MIT License. {filler}") == ("MIT", 1.0)
    for mention in ("someone wrote that the MIT License is short and liked", "a long essay about the GNU General Public License version 3 appeared yesterday", "sold to others and licensed under the Acme terms of trade"):
        assert t.scan(f"{filler} {mention} {filler}") == (None, 0.0)


HEADER = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_near_equal_licences_are_told_apart():
    t = L.Templates()
    for name, version, licence in (
        ("General Public License", "2", "GPL-2.0"), ("General Public License", "3", "GPL-3.0"), ("Lesser General Public License", "2.1", "LGPL-2.1"),
        ("Lesser General Public License", "3", "LGPL-3.0"), ("Affero General Public License", "3", "AGPL-3.0"),
    ):
        header = HEADER.format(name, version)
        assert t.scan(header)[0] == t.scan("# " + header.replace("the ", "the\n# "))[0] == t.scan(header.replace("program", "library"))[0] == licence
    rest = "\nTHIS SOFTWARE IS PROVIDED AS IS AND ANY WARRANTIES ARE DISCLAIMED."
    for text, licence in ((CLAUSES + rest, "BSD-2-Clause"), (CLAUSES + THIRD + rest, "BSD-3-Clause")):
        assert t.scan(text)[0] == t.scan(text.replace("\n", " "))[0] == licence


def test_bounds_lose_nothing():
    """Every line window and sentence scored without any gate gives the same licence and cosine."""
    templates, r = L.Templates(), random.Random(6)
    filler = "mit general zero the a of und work use software free word".split() + [f"w{i}" for i in range(40)]
    notices = [t for texts in L.TEMPLATES.values() for t in texts]

    def plainly(text):
        lines, found = L.plain(text).split("\n"), (0.0, "")
        for i, line in enumerate(lines):
            parts = ["\n".join(lines[i : i + n]) for n in (1, 2, 4, L.LINES_AFTER)] + [m[0] for m in L.SENTENCE.finditer(line)]
            found = max([found, *(templates.best(L.WORD.findall(p)) for p in parts)], key=L.better)
        ws = L.WORD.findall(L.plain(text))
        found = max((found, *templates.windows(ws)), key=L.better)
        if found[1] in L.BSD:
            found = found[0], L.clauses(" ".join(ws)) or found[1]
        return (found[1], found[0]) if found[0] >= L.MIN_SCORE else (None, 0.0)

    named = 0
    for _ in range(150):
        words = r.choice(notices).split()
        words = words[: r.randint(1, len(words))] if r.random() < 0.5 else words
        text = [" ".join(r.choices(filler, k=r.randint(0, 12))) for _ in range(r.randint(0, 12))]
        text.insert(r.randint(0, len(text)), " ".join(r.choices(filler, k=r.randint(0, 3)) + words))
        got = templates.scan(r.choice(["\n", " "]).join(text) if r.random() < 0.7 else "\n".join(text).replace(" ", "\n"))
        named += got[0] is not None
    assert named > 30
    for _ in range(150):
        text = "\n".join(" ".join(r.choices(filler, k=r.randint(0, 12)) + r.choice(notices).split()[: r.randint(0, 40)]) for _ in range(r.randint(1, 6)))
        assert templates.scan(text) == plainly(text)
