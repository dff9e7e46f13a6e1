"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

The inverse document frequencies of the templates' terms are counted over all files, as sums per partition, so their number is that
of the terms and not of the files. Every line, every run of lines without one between that has no terms, every sentence of such a
run, every window of as many terms as a template has, and the whole of each file is then compared with the
templates. What cannot reach the least score is left out by bounds that hold for every part of a text. Licences of one family differ in a
few words that a cosine hardly sees, so a place counts for a licence only if it holds the terms that tell the licence from its
family, and none of those that tell the others. A file with a match has that licence from its header; a licence file, which is one by its
name or because its whole text is a licence, gives its licence to its directory; a file without one inherits that of the nearest directory above it, by joins over
paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import Workspace, join_groups

#: The words by which well-known licences name themselves in headers and licence files.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_NC, _SA, _ND = ("nc", "noncommercial"), ("sa", "sharealike"), ("nd", "noderivatives", "noderivs")
_GNU = ("gpl", "gpl-2.0", "gpl-3.0", "gnu")
#: Of licences that have near relatives, the terms of which a place has to hold one each, and those it must not hold.
TELLING = {
    "GPL-2.0": ([("2", "2.0", "gpl-2.0", "gplv2"), _GNU], ("affero", "lesser", "library", "agpl", "lgpl", "3")),
    "GPL-3.0": ([("3", "3.0", "gpl-3.0", "gplv3"), _GNU], ("affero", "lesser", "library", "agpl", "lgpl", "2")),
    "AGPL-3.0": ([("affero", "agpl-3.0", "agpl"), ("3", "3.0", "agpl-3.0")], ("lesser",)),
    "LGPL-2.1": ([("lesser", "lgpl-2.1", "lgpl"), ("2.1", "lgpl-2.1")], ("affero",)),
    "LGPL-3.0": ([("lesser", "lgpl-3.0", "lgpl"), ("3", "3.0", "lgpl-3.0")], ("affero",)),
    "BSD-3-Clause": ([("neither", "endorse", "style", "bsd-3")], ()),
    "BSD-2-Clause": ([("reproduce", "bsd-2")], ("neither", "endorse")),
    "Apache-2.0": ([("apache", "license"), ("apache", "apache-2.0", "express", "implied")], ()),
    "CC-BY-4.0": ([("4.0", "4")], (*_NC, *_SA, *_ND)),
    "CC-BY-NC-4.0": ([_NC, ("4.0", "4")], (*_SA, *_ND)),
    "CC-BY-SA-4.0": ([_SA, ("4.0", "4")], (*_NC, *_ND)),
    "CC-BY-ND-4.0": ([_ND, ("4.0", "4")], (*_NC, *_SA)),
    "CC-BY-NC-SA-4.0": ([_NC, _SA, ("4.0", "4")], _ND),
    "CC0-1.0": ([("cc0", "cc0-1.0", "dedication", "dedicated")], ()),
}
#: A licence whose text goes on where another's ends; where the first is found, the second is none.
GOES_ON = {"BSD-3-Clause": "BSD-2-Clause"}
TERM = re.compile(r"[a-z0-9]+(?:[.-][0-9]+)*")
SENTENCE = re.compile(r"[.!?;:]\s")
#: Bounds are computed in another order than scores; this much is allowed for rounding.
SLACK = 1e-9
#: What marks a file as its directory's licence, by its name.
LICENSE_FILE = r"(?i)^(un)?(licen[cs]es?|copying|copyright|notice)([.\-_].*)?$"
TERM_TYPES = "term string, n long"
MATCH_TYPES = "file long, path string, license string, score double, line long, whole boolean"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def vocabulary(templates: dict[str, list[str]]) -> list[str]:
    return sorted({t for texts in templates.values() for text in texts for t in terms(text)})


def _frequencies(known: frozenset[str]):
    """(term, files of this partition that hold it), and (null, files)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for data in batches:
            for text in data.column(0).to_pylist():
                found.update(known.intersection(terms(text or "")))
                found[None] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return run


def inverse_frequencies(files: DataFrame, text_col: str, known: list[str]) -> tuple[dict[str, float], float]:
    """The terms' idf over all files, and that of terms which no file holds. As many numbers as there are terms."""
    counts = dict(files.select(text_col).mapInArrow(_frequencies(frozenset(known)), TERM_TYPES).groupBy("term").agg(F.sum("n").alias("n")).collect())
    n = counts.get(None, 0)
    return {t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 1 for t in known}, math.log(n + 1) + 1


class Matcher:
    """Cosine of TF-IDF vectors to the templates. Terms that are in no template weigh as those that no file holds."""

    def __init__(self, templates: dict[str, list[str]], idf: dict[str, float], rare: float):
        self.idf, self.rare = idf, rare
        self.vectors = []
        self.lengths = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                weights = {t: c * idf[t] for t, c in Counter(terms(text)).items()}
                norm = math.sqrt(sum(w * w for w in weights.values()))
                self.vectors.append((name, {t: w / norm for t, w in weights.items()}))
                self.lengths.append(len(terms(text)))
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for i, (_, vector) in enumerate(self.vectors):
            for t, w in vector.items():
                self.by_term.setdefault(t, []).append((i, w))

    def best(self, counts: Counter, least: float = 0.0) -> list[tuple[float, str]]:
        """The licences with a cosine of least or more whose telling terms allow it, with their cosines, the best first, then by name."""
        dots: dict[int, float] = {}
        norm = 0.0
        for t, c in counts.items():
            w = self.idf.get(t)
            if w is None:
                norm += (c * self.rare) ** 2
                continue
            norm += (c * w) ** 2
            for i, v in self.by_term[t]:
                dots[i] = dots.get(i, 0.0) + c * w * v
        norm = math.sqrt(norm)
        found: dict[str, float] = {}
        for i, dot in dots.items():
            name = self.vectors[i][0]
            if dot / norm >= max(least, found.get(name, 0.0)) and self.tells(name, counts):
                found[name] = dot / norm
        return sorted(((score, name) for name, score in found.items()), key=lambda x: (-x[0], x[1]))

    @staticmethod
    def tells(name: str, counts: Counter) -> bool:
        """Whether the terms allow a licence."""
        needs, bars = TELLING.get(name, ((), ()))
        return all(any(t in counts for t in some) for some in needs) and not any(t in counts for t in bars)

    def cosine(self, i: int, counts: Counter) -> float:
        """The cosine to template i."""
        vector = self.vectors[i][1]
        weights = {t: c * self.idf.get(t, self.rare) for t, c in counts.items()}
        return sum(w * vector.get(t, 0.0) for t, w in weights.items()) / math.sqrt(sum(w * w for w in weights.values()))

    def could(self, present: set[str], least: float) -> list[int]:
        """The templates that some part of a text with these terms could match.

        By Cauchy-Schwarz no part has a higher cosine than the length of the template's vector over the terms that are there.
        """
        held: dict[int, float] = {}
        for t in self.idf.keys() & present:
            for i, v in self.by_term[t]:
                held[i] = held.get(i, 0.0) + v * v
        return sorted(i for i, h in held.items() if h >= least * least - SLACK)

    def windows(self, i: int, found: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of template i's length that could reach least, and their bounds, the highest first.

        A term's weights in a window add up before they are squared, so the sum of the squares bounds the norm from below.
        """
        size, (_, vector) = self.lengths[i], self.vectors[i]
        weights = np.array([self.idf.get(t, self.rare) for t in found])
        dots = np.cumsum(np.concatenate([[0.0], weights * [vector.get(t, 0.0) for t in found]]))
        squares = np.cumsum(np.concatenate([[0.0], weights * weights]))
        bounds = (dots[size:] - dots[:-size]) / np.sqrt(np.maximum(squares[size:] - squares[:-size], SLACK)) + SLACK
        starts = np.flatnonzero(bounds >= least)
        starts = starts[np.argsort(-bounds[starts], kind="stable")]
        return starts, bounds[starts]


def matches(text: str, matcher: Matcher, least: float) -> dict[str, tuple[float, int, bool]]:
    """Of each licence found in a text the best score, the first line (from 0) of the place, and whether the whole text is that licence."""
    text = text.lower()
    found = TERM.findall(text)
    likely = matcher.could(set(found), least)
    if not likely:
        return {}
    out: dict[str, tuple[float, int]] = {}

    def keep(score: float, name: str, line: int) -> None:
        if score >= least and (name not in out or (score, -line) > (out[name][0], -out[name][1])):
            out[name] = score, line

    def add(counts: Counter, line: int) -> None:
        if not matcher.idf.keys().isdisjoint(counts):
            for score, name in matcher.best(counts, least)[:1]:
                keep(score, name, line)

    run: list[str] = []
    first = 0
    lines = text.split("\n")
    places: list[int] = []  # the line of each term
    for i, line in enumerate([*lines, ""]):
        own = TERM.findall(line)
        if own:
            places += [i] * len(own)
            add(Counter(own), i)
            run.append(line)
            continue
        if run:
            if 1 < len(run) < len(lines):
                add(Counter(TERM.findall("\n".join(run))), first)
            at = first
            for part, gap in _sentences("\n".join(run)):
                add(Counter(TERM.findall(part)), at + len(part[: m.start()].split("\n")) - 1 if (m := TERM.search(part)) else at)
                at += (part + gap).count("\n")
        run, first = [], i + 1
    every = Counter(found)
    whole = {name for _, name in matcher.best(every, least)}
    if len(lines) > 1:
        add(every, 0)
    for i in likely:
        name, size = matcher.vectors[i][0], matcher.lengths[i]
        if size > len(found):
            continue
        for start, bound in zip(*(a.tolist() for a in matcher.windows(i, found, least)), strict=True):
            if bound < out.get(name, (0.0, 0))[0]:
                break
            counts = Counter(found[start : start + size])
            if matcher.tells(name, counts):
                keep(matcher.cosine(i, counts), name, places[start])
    for name, other in GOES_ON.items():
        if name in out:
            out.pop(other, None)
    return {name: (*place, name in whole) for name, place in out.items()}


def _sentences(text: str) -> Iterator[tuple[str, str]]:
    """The sentences of a text, each with the mark and white space that end it."""
    at = 0
    for m in SENTENCE.finditer(text):
        yield text[at : m.start()], m[0]
        at = m.end()
    yield text[at:], ""


def _matches(templates: dict[str, list[str]], idf: dict[str, float], rare: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, idf, rare)
        for data in batches:
            rows = [(file, path, name, *place) for file, path, text in zip(*(c.to_pylist() for c in data.columns), strict=True) for name, place in matches(text or "", matcher, least).items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_()), strict=True)], names=["file", "path", "license", "score", "line", "whole"])

    return run


def directory(path: Column) -> Column:
    """The path up to its last slash; empty for a file at the top."""
    return F.regexp_extract(path, r"^(?s)(.*)/", 1)


def ancestors(folder: Column) -> Column:
    """The folder, those above it, and the empty top."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def license_scan(files: DataFrame, id_col: str = "file", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = 0.75, work: Workspace | None = None) -> DataFrame:
    """(file, path, license, origin, score, line, from_dir) of every row of files.

    origin is "file" for a licence file (by its name, or because its whole text reaches least), "header" for a match in another file, "inherited" for a file without a match below a directory
    with a licence file, and "none". Of several matches the best score counts, then the first name. A directory has the best
    matching licence of its licence files, and from_dir names the directory that a licence is inherited from. The
    whole text is searched. A null text matches nothing, a null path is a file at the top without a name; rows that repeat an id
    share their matches. Terms are runs of ASCII letters and digits, lower-cased. An empty table gives an empty
    result; further columns are not read.
    """
    spark = files.sparkSession
    work = work or Workspace(spark, "licences")
    templates = TEMPLATES if templates is None else templates
    texts = files.select(F.col(id_col).cast("long").alias("file"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    idf, rare = inverse_frequencies(texts, "text", vocabulary(templates))
    found = work.put("found", texts.mapInArrow(_matches(templates, idf, rare, least), MATCH_TYPES))
    best = found.groupBy("file", "path").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license", "line", "whole")).alias("b"))
    best = best.select(F.col("file").alias("m_file"), F.col("path").alias("m_path"), "b.license", (-F.col("b.minus")).alias("score"), "b.line", "b.whole")
    names = texts.select("file", "path", directory(F.col("path")).alias("dir"))
    own = names.join(best, F.col("file").eqNullSafe(F.col("m_file")) & (F.col("path") == F.col("m_path")), "left").drop("m_file", "m_path")
    own = work.put("own", own.withColumn("gives", F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE) | F.coalesce("whole", F.lit(False))).drop("whole"))
    given = own.where("gives and license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")).select(F.col("dir").alias("from_dir"), F.col("b.license").alias("dir_license"))
    folders = work.put("folders", own.groupBy("dir").agg(F.count("*").alias("size")))
    above = folders.select("dir", "size", F.posexplode(ancestors(F.col("dir"))).alias("depth", "from_dir")).join(given, "from_dir")
    nearest = above.groupBy("dir", "size").agg(F.max(F.struct("depth", "from_dir", "dir_license")).alias("n")).select("dir", "size", "n.from_dir", "n.dir_license")
    done = join_groups(own, work.put("nearest", nearest), ["dir"], "size")
    inherits = F.col("license").isNull() & F.col("dir_license").isNotNull()
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("gives"), "file").otherwise("header")).when(inherits, "inherited").otherwise("none")
    return done.select("file", "path", F.coalesce("license", "dir_license").alias("license"), origin.alias("origin"), "score", "line", F.when(inherits, F.col("from_dir")).alias("from_dir"))
