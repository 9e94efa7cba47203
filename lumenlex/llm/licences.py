"""License scans: headers and licence files against templates, then inheritance down the directory tree.

Each line of a text, alone and together with the lines after it, and each sentence is a sparse TF-IDF vector, unless
no licence's own word stands in it, without which none is named, or its unknown words bound the cosine below what is
wanted; its cosine with the templates' vectors names the licence. Besides, wherever an anchor word of a
template of four words or more stands, the words around it, as many as the template has, are compared with that
template: a notice is found anywhere in a line and across lines. Words that no template knows lengthen the vector, so
a sentence that only mentions a licence scores low; a bare title such as "MIT License" counts as a line or sentence of
its own, not amid one. A licence is only named where one of its own words stands, and telling words decide between
near-equal ones: lesser or affero against GPL, the third clause against the two-clause BSD. Weights come from the
templates alone. A row whose file name is that
of a licence file gives its licence to its directory; a row without a licence of its own takes that of its nearest
ancestor directory, by an equi-join of its ancestor paths with the directories.

Defined results: a NULL or empty text has no licence of its own. A NULL path has no ancestors. Of several licences in
a text, the one with the highest cosine wins, ties by name; of several licence files in a directory, likewise, then by
path. Rows that repeat are scanned each for itself. Whole texts are read. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.shared import cut

MIN_SCORE, LINES_AFTER = 0.55, 8
#: Bytes of a table that may be broadcast, and rows of a directory in one task.
BROADCAST_BYTES, KEY_ROWS = 1 << 25, 100_000
SENTENCE = re.compile(r"[^\n]+?(?:[.!?;](?=\s)|(?=\n)|\Z)")
#: Words of templates that a window is laid around, and the words of the shortest template that has windows.
ANCHORS, SHORTEST = frozenset("license licensed spdx permission redistribute redistribution domain gnu creative".split()), 4
WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
FILE_NAMES = ("license", "licence", "copying", "unlicense", "notice")

# Wording of licence headers, notices and the telling sentences of licence texts.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0", "GNU General Public License Version 2, June 1991",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", "GNU General Public License Version 3, 29 June 2007",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Simplified BSD License, two clauses",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "New BSD License, three clauses",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met; neither the name of the copyright holder may be used to endorse products",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "ISC": ("Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC0-1.0": ("Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "Creative Commons Zero 1.0 Universal public domain dedication"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
# Words of which one must stand in a text of the licence.
OWN_WORDS = {
    "MIT": {"mit", "hereby"}, "Apache-2.0": {"apache"}, "GPL-2.0": {"gnu", "gpl", "general"}, "GPL-3.0": {"gnu", "gpl", "general"},
    "LGPL-3.0": {"lesser", "library", "lgpl"}, "LGPL-2.1": {"lesser", "library", "lgpl"}, "AGPL-3.0": {"affero", "agpl"},
    "BSD-2-Clause": {"bsd", "redistribution"}, "BSD-3-Clause": {"bsd", "redistribution", "neither", "endorse"}, "MPL-2.0": {"mozilla", "mpl"}, "ISC": {"isc", "hereby"},
    "Unlicense": {"unencumbered", "unlicense"}, "CC0-1.0": {"0", "zero"}, "CC-BY-4.0": {"cc", "attribution"}, "CC-BY-SA-4.0": {"sa", "sharealike"},
    "CC-BY-NC-4.0": {"nc", "noncommercial"}, "CC-BY-NC-SA-4.0": {"nc", "noncommercial"}, "CC-BY-ND-4.0": {"nd", "noderivatives"},
}

# Words that tell a text from the near-equal licence of that name; the clauses that both BSD licences
# begin with, what only the three-clause one says, and how many words after the clauses begin it may say so.
TELLING = dict.fromkeys(("GPL-2.0", "GPL-3.0"), re.compile(r"\b(?:lesser|affero|library) (?:general|gpl)\b|\b[al]gpl\b"))
BSD, CLAUSES, THIRD_CLAUSE, CLAUSE_WORDS = ("BSD-2-Clause", "BSD-3-Clause"), "redistribution and use in source and binary forms", re.compile(r"\bneither the names?\b|\bto endorse\b"), 200


def plain(text: str) -> str:
    return text.lower().replace("licence", "license")


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))


def told(name: str, text: str) -> bool:
    """Whether text has a word that tells it from the licence of that name."""
    return name in TELLING and TELLING[name].search(text) is not None


def clauses(text: str) -> str | None:
    """Which BSD licence the clauses in text are of, if they are there."""
    if CLAUSES not in text:
        return None
    after = (" ".join(t.split(" ", CLAUSE_WORDS)[:CLAUSE_WORDS]) for t in text.split(CLAUSES)[1:])
    return BSD[any(THIRD_CLAUSE.search(t) for t in after) or "bsd 3 clause" in text]


def better(p: tuple[float, str]) -> tuple[float, list[int]]:
    return p[0], [-ord(c) for c in p[1]]


class Templates:
    """Sparse vectors of the templates, of length 1, by word."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        texts = [(name, words(text)) for name, texts in sorted(templates.items()) for text in texts]
        rows = [(name, Counter(ws)) for name, ws in texts]
        df = Counter(w for _, counts in rows for w in counts)
        self.idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
        self.unknown = math.log(1 + len(rows)) + 1
        self.names = [name for name, _ in rows]
        self.own = [OWN_WORDS.get(name, set(counts)) for name, counts in rows]
        self.vectors = [self.unit(counts) for _, counts in rows]
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for i, vector in enumerate(self.vectors):
            for w, x in vector.items():
                self.by_word.setdefault(w, []).append((i, x))
        # By anchor word: the templates that hold it, where, and how many words they have.
        self.at_anchor: dict[str, list[tuple[int, int, int]]] = {}
        for i, (_, ws) in enumerate(texts):
            for at, w in enumerate(ws):
                if w in ANCHORS and len(ws) >= SHORTEST:
                    self.at_anchor.setdefault(w, []).append((i, at, len(ws)))
        self.longest = max((len(ws) for _, ws in texts), default=0)
        # No licence is named without one of its own words, so lines without any have nothing to compare.
        some = lambda ws: re.compile(rf"(?<![a-z])(?:{'|'.join(map(re.escape, sorted(ws)))})(?![a-z])" if ws else r"(?!)")
        self.any_own, self.any_anchor = some(set().union(*self.own)), some(set(self.at_anchor))

    def weigh(self, ws: list[str]) -> tuple[float, float]:
        """Bounds of the squared weights of a text that holds ws: of known words at most, of unknown ones at least.

        A word that stands n times has the weight (1 + ln n) * idf, whose square is below 1.5 * n * idf * idf.
        """
        idf = self.idf
        known = sum(1.5 * idf[w] * idf[w] for w in ws if w in idf)
        return known, len(set(ws) - idf.keys()) * self.unknown * self.unknown

    @staticmethod
    def may_reach(known: float, unknown: float, least: float) -> bool:
        """Whether a cosine of least is possible: known words make at most their share of the vector's length."""
        return known * (1 - least * least) >= least * least * unknown * (1 - 1e-9)

    def unit(self, counts: Counter) -> dict[str, float]:
        weighed = {w: (1 + math.log(n)) * self.idf.get(w, self.unknown) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in weighed.values()))
        return {w: x / norm for w, x in weighed.items()}

    def best(self, ws: list[str], least: float = 0.0) -> tuple[float, str]:
        """The highest cosine of the templates whose own words stand in ws, and the licence; none if it can't reach least."""
        counts, scores = Counter(ws), {}
        common = counts.keys() & self.idf.keys()
        known = sum(((1 + math.log(counts[w])) * self.idf[w]) ** 2 for w in common)
        if not self.may_reach(known, (len(counts) - len(common)) * self.unknown * self.unknown, least):
            return 0.0, ""
        for w, x in self.unit(counts).items():
            for i, y in self.by_word.get(w, ()):
                scores[i] = scores.get(i, 0.0) + x * y
        text = " ".join(ws)
        return max(((round(s, 9), self.names[i]) for i, s in scores.items() if not self.own[i].isdisjoint(ws) and not told(self.names[i], text)), key=better, default=(0.0, ""))

    def windows(self, ws: list[str]) -> Iterator[tuple[float, str]]:
        """The cosine of each template with as many words around each of its anchors, and the licence."""
        seen: set[tuple[str, ...]] = set()
        for p, w in enumerate(ws):
            held = self.at_anchor.get(w)
            if not held:
                continue
            low = max(0, p - self.longest)
            around = tuple(ws[low : p + self.longest])
            if (p - low, *around) in seen:
                continue
            seen.add((p - low, *around))
            near, spans = set(around), {}
            for i, at, n in held:
                if not self.own[i].isdisjoint(near):
                    spans.setdefault((max(0, p - at), p - at + n), []).append(i)
            for (start, end), found in spans.items():
                counts = Counter(ws[start:end])
                vector = None
                for i in found:
                    if not self.own[i].isdisjoint(counts) and not told(self.names[i], " ".join(ws[start:end])):
                        vector = vector or self.unit(counts)
                        yield round(sum(x * vector.get(t, 0.0) for t, x in self.vectors[i].items()), 9), self.names[i]

    def scan(self, text: str | None, least: float = MIN_SCORE) -> tuple[str | None, float]:
        """The licence of a whole text and its cosine."""
        text = plain(text) if text else ""
        if not self.any_own.search(text):
            return None, 0.0
        lines, found, seen = text.split("\n"), (0.0, ""), set()
        holds = [self.any_own.search(line) is not None for line in lines]
        weighed: dict[int, tuple[float, float]] = {}
        for i in sorted({j for i, held in enumerate(holds) if held for j in range(max(0, i - LINES_AFTER + 1), i + 1)}):
            for j in range(i, min(i + LINES_AFTER, len(lines))):
                if j not in weighed:
                    weighed[j] = self.weigh(WORD.findall(lines[j]))
            parts = []
            for n in (1, 2, 4, LINES_AFTER):
                held = range(i, min(i + n, len(lines)))
                known, unknown = sum(weighed[j][0] for j in held), max(weighed[j][1] for j in held)
                if any(holds[i : i + n]) and self.may_reach(known, unknown, least):
                    parts.append(WORD.findall("\n".join(lines[i : i + n])))
            sentences = [WORD.findall(m[0]) for m in SENTENCE.finditer(lines[i])] if holds[i] else []
            for part in parts + [ws for ws in sentences if self.may_reach(*self.weigh(ws), least)]:
                if (key := tuple(part)) not in seen:
                    seen.add(key)
                    found = max(found, self.best(part, least), key=better)
        ws = []
        if self.any_anchor.search(text):
            ws = WORD.findall(text)
            found = max((found, *self.windows(ws)), key=better)
        if found[1] in BSD:
            found = found[0], clauses(" ".join(ws or WORD.findall(text))) or found[1]
        return (found[1], found[0]) if found[0] >= least else (None, 0.0)


def scan(files: DataFrame, path: Column, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, path, licence, score, scope (own, inherited or none), licence_path for every row of files(doc_id, text)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        templates = Templates()
        for b in batches:
            found = [templates.scan(t.as_py(), min_score) for t in b]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["licence", "score"])

    scanner = F.arrow_udf(run, "licence string, score double", F.ArrowUDFType.SCALAR_ITER)
    # Kept, as three branches read it: each text is scanned once.
    own = cut(files.select("doc_id", path.alias("path"), scanner("text").alias("found")).select("doc_id", "path", "found.licence", "found.score"))
    base = F.lower(F.substring_index("path", "/", -1))
    is_file = F.col("path").isNotNull() & F.col("licence").isNotNull() & F.split_part(base, F.lit("."), F.lit(1)).isin(*FILE_NAMES)
    holder = F.struct((-F.col("score")).alias("order"), "licence", F.col("path").alias("licence_path"))
    given = own.where(is_file).groupBy(_directory(F.col("path")).alias("dir")).agg(F.min(holder).alias("held"))
    # By directory, not by file: its ancestors are itself, itself without its last part, and so on. The root, ancestor of
    # all, would be the one key of a third and more of the rows, so its single row is no part of the join.
    at = _directory(F.col("path")).alias("at")
    bare = own.where(F.col("licence").isNull() & F.col("path").isNotNull()).select(at).distinct()
    parts = F.split("at", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    steps = bare.select("at", F.inline(chain)).where("dir <> ''")
    below = cut(given.where("dir <> ''"))
    nearest = cut(_looked_up(steps, below, "dir", "inner").groupBy("at").agg(F.max_by("held", "depth").alias("from")))
    root = given.where("dir = ''").select("held.*").first()
    out = _looked_up(own.withColumn("at", at), nearest, "at", "left")
    if root is not None:
        at_root = F.struct(*(F.lit(value).alias(name) for name, value in root.asDict().items()))
        out = out.withColumn("from", F.coalesce("from", F.when(F.col("path").isNotNull(), at_root)))
    inherits = F.col("licence").isNull() & F.col("path").isNotNull() & F.col("from").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.when(inherits, F.col("from.licence")).otherwise(F.col("licence")).alias("licence"),
        F.when(inherits, -F.col("from.order")).otherwise(F.col("score")).alias("score"),
        F.when(inherits, "inherited").when(F.col("licence").isNotNull(), "own").otherwise("none").alias("scope"),
        F.when(inherits, F.col("from.licence_path")).when(F.col("licence").isNotNull(), F.col("path")).alias("licence_path"),
    )


def _looked_up(rows: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with table, which holds one row for each key; a third of rows may have the same key.

    A table of at most BROADCAST_BYTES, measured, is broadcast. A larger one meets rows in a shuffle, where keys of more
    than KEY_ROWS rows are salted; the list of such keys has one row for every KEY_ROWS rows at most.
    """
    size = table.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))) + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > KEY_ROWS)
    hot = cut(counts.select(key, F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), copies).cast("int"))
    spread = table.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.drop("copies").join(spread.drop("copies"), [key, "salt"], how).drop("salt")


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the licence of every document; a document is the file ``source/doc_id``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return scan(docs, F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")))
