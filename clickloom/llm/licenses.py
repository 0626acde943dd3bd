"""License scan: sparse TF-IDF cosine of texts to notice templates, then inheritance from the nearest directory with a licence file.

Compared are single lines and, across line breaks and comment marks, every passage of a template's length: wrapped headers, notices
inside longer lines, and whole licence files. All are bags of terms. Their cosines need nothing but the text and the templates, so they
are taken where the text is read: only hits leave the task, no text and no term is shuffled. Directories inherit by an equi-join of every
ancestor path with the licensed directories; the deepest one counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.batches import short_batches
from clickloom.plans.stage import written

# Public licence notices, as they stand in file headers and licence files.
TEMPLATES = {
    "AGPL-3.0-short": "Released under the GNU Affero General Public License version 3.",
    "AGPL-3.0-title": "GNU Affero General Public License Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution",
    "BSD-2-Clause-short": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-short": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    "GPL-2.0-short": "Released under the GNU General Public License version 2.",
    "GPL-2.0-short2": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-title": "GNU General Public License Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "GPL-3.0-short": "Released under the GNU General Public License version 3.",
    "GPL-3.0-short2": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-title": "GNU General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "LGPL-3.0-short": "Released under the GNU Lesser General Public License version 3.",
    "LGPL-3.0-title": "GNU Lesser General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MIT-short": "Released under the MIT License.",
    "MIT-short2": "This work is licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "MPL-2.0-title": "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity",
}
MIN_COSINE = 0.8
FILE_WORDS = 40
FILE_NAME = r"(?i)(\A|/)([a-z0-9]+[-_])?(un)?(licen[cs]e|copying|copyright|notice)([-_][^/.]*)?(\.(txt|md|rst|html?|lesser|mit|bsd|apache|[al]?gpl))?\z"
TERM = re.compile(rb"[a-z0-9.]+")
VARIANT = re.compile(r"-(short\d*|text|title)\Z")
MARK = re.compile(rb"(?im)^[ \t]*(?:dnl|rem|c)[ \t]+")  # comment marks of other signs are no terms
OPENING = 3  # terms that may stand before the title of a licence file


def terms_of(line: bytes) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, digits and inner points of a line in UTF-8."""
    return [t for t in (x.strip(b".") for x in TERM.findall(line.lower())) if t]


def template_weights(templates: Mapping[str, str] = TEMPLATES) -> list[tuple[str, str, str, float, float]]:
    """(template, license, term, weight, idf): unit vectors; a term's idf is ln((1 + templates) / (1 + templates with it)) + 1."""
    counts = {name: Counter(t.decode() for t in terms_of(text.encode())) for name, text in sorted(templates.items())}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        out += [(name, VARIANT.sub("", name), t, n * idf[t] / norm, idf[t]) for t, n in sorted(c.items())]
    return out


def telling_terms(weights: list[tuple[str, str, str, float, float]], min_cosine: float) -> list[str]:
    """Terms of which a line must hold at least one: without them its cosine to every template stays below ``min_cosine``."""
    out = set()
    for name in {w[0] for w in weights}:
        left_out = 0.0
        for _, _, term, weight, _ in sorted((w for w in weights if w[0] == name), key=lambda w: (w[4], len(w[2]), w[2])):
            left_out += weight * weight
            if left_out >= min_cosine * min_cosine - 1e-6:
                out.add(term)
    return sorted(out)


def matcher(templates: Mapping[str, str], min_cosine: float) -> Callable[[bytes], tuple[str, float, bool] | None]:
    """A function that gives the best (license, cosine) over the lines and passages of a text and whether the text is itself a license, or None.

    It is if it opens with a ``-title`` or matches a ``-text`` as a whole. That decides alone, for a license names others too.
    """
    weights = template_weights(templates)
    unseen = math.log(1 + len(templates)) + 1
    idf = {w[2].encode(): w[4] for w in weights}
    rows: dict[bytes, list[tuple[str, float]]] = {}
    for name, _, term, weight, _ in weights:
        rows.setdefault(term.encode(), []).append((name, weight))
    license_of = {w[0]: w[1] for w in weights}
    telling = {t.encode() for t in telling_terms(weights, min_cosine)}
    code = {term: i + 1 for i, term in enumerate(idf)}
    worth = np.array([unseen, *idf.values()])
    sizes = {name: len(terms_of(text.encode())) for name, text in templates.items()}
    gains = {name: np.zeros(len(worth)) for name in sizes}
    for name, _, term, weight, own in weights:
        gains[name][code[term.encode()]] = own * weight

    def cosines(bag: Counter) -> dict[str, float]:
        norm = math.sqrt(sum((n * idf.get(t, unseen)) ** 2 for t, n in bag.items()))
        dots: dict[str, float] = {}
        for term in bag.keys() & rows.keys():
            for name, weight in rows[term]:
                dots[name] = dots.get(name, 0.0) + bag[term] * idf[term] * weight
        return {name: round(dot / norm, 9) for name, dot in dots.items()}

    def possible(terms: list[bytes]) -> list[str]:
        """Templates that some bag of these terms can match: a cosine is at most the weight of the template's terms that are there."""
        squares: dict[str, float] = {}
        for term in rows.keys() & set(terms):
            for name, weight in rows[term]:
                squares[name] = squares.get(name, 0.0) + weight * weight
        return [name for name, x in squares.items() if x >= min_cosine * min_cosine - 1e-6]

    def passages(names: list[str], terms: list[bytes]) -> Iterator[tuple[str, float, int]]:
        """(template, cosine, first term) of each passage as long as the template whose cosine is high enough."""
        if not terms:
            return
        codes = np.fromiter((code.get(t, 0) for t in terms), np.int64, len(terms))
        squares = np.concatenate([[0.0], np.cumsum(worth[codes] ** 2)])
        for name in names:
            size = min(sizes[name], len(terms))
            dot = np.concatenate([[0.0], np.cumsum(gains[name][codes])])
            dot, least = dot[size:] - dot[: len(dot) - size], squares[size:] - squares[: len(squares) - size]
            # A passage's norm is at least that of its terms if none came twice.
            for i in np.flatnonzero(dot * dot >= min_cosine * min_cosine * least - 1e-6):
                norm = math.sqrt(sum((n * worth[c]) ** 2 for c, n in Counter(codes[i : i + size].tolist()).items() if c)
                                 + unseen * unseen * sum(n * n for n in Counter(t for t in terms[i : i + size] if t not in code).values()))
                cosine = round(float(dot[i]) / norm, 9)
                if cosine >= min_cosine:
                    yield name, cosine, int(i)

    def best(text: bytes) -> tuple[str, float, bool] | None:
        terms, hits = terms_of(text), []
        names = possible(terms)
        if not names:
            return None
        for line in text.split(b"\n"):
            bag = Counter(terms_of(line))
            if telling.isdisjoint(bag):
                continue
            hits += [(-c, license_of[name]) for name, c in cosines(bag).items() if c >= min_cosine]
        wholes = []
        for name, c, at in passages(names, terms_of(MARK.sub(b"", text))):
            hits.append((-c, license_of[name]))
            if name.endswith("-title") and at <= OPENING:
                wholes.append(hits[-1])
        # The whole text against whole licences.
        wholes += [(-c, license_of[name]) for name, c in cosines(Counter(terms)).items() if name.endswith("-text") and c >= min_cosine]
        top = min(wholes or hits, default=None)
        return top and (top[1], -top[0], bool(wholes))

    return best


def _hits(files: DataFrame, path: str, text: str, templates: Mapping[str, str], min_cosine: float) -> DataFrame:
    """(path, license, cosine, whole) of ``scan``, with whether the file is itself a license."""
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = matcher(templates, min_cosine)
        for b in batches:
            hits = [(p.as_py(), *hit) for p, t in zip(b.column(0), b.column(1), strict=True) if (hit := best(t.as_py()))]
            arrays = [pa.array([h[i] for h in hits], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "license", "cosine", "whole"])

    rows = files.where(F.col(path).isNotNull() & F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).cast("binary").alias("text"))
    hits = short_batches(rows).mapInArrow(run, "path string, license string, cosine double, whole boolean")
    best = hits.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("below"), "license")).alias("top"), F.max("whole").alias("whole"))
    return best.select("path", F.col("top.license").alias("license"), (-F.col("top.below")).alias("cosine"), "whole")


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: Mapping[str, str] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(path, license, cosine): the best license of each file that has a line or passage with cosine ``min_cosine`` or more to a template.

    The whole text counts. A term that no template has weighs as one that no template had (the largest idf). Names ending in
    ``-short``, ``-short2`` ..., ``-text`` or ``-title`` are further texts of the same license; ties go to the first license name. Files without
    a hit, with a null text or a null path have no row; rows that share a path are one file.
    """
    return _hits(files, path, text, templates, min_cosine).drop("whole")


def directory_of(path: Column) -> Column:
    """The path up to its last slash; a path without one lies in the root, ''."""
    return F.regexp_replace(path, "/?[^/]*\\z", "")


def inherit(files: DataFrame, found: DataFrame, licence_files: DataFrame, path: str = "path") -> DataFrame:
    """The rows of ``files`` with ``license``, ``cosine``, ``how`` (own, inherited or null) and ``source_path``.

    A file without a row in ``found`` takes the license of the nearest ancestor directory that holds one of ``licence_files``
    (path, license); of several in one directory the first path counts. Ancestors are joined per directory, not per
    file. A null path inherits nothing.
    """
    kept = [c for c in files.columns if c not in ("license", "cosine", "how", "source_path")]
    held = licence_files.select(directory_of(F.col("path")).alias("up"), F.struct("path", "license").alias("_file")).groupBy("up").agg(F.min("_file").alias("_file"))
    dirs = files.where(F.col(path).isNotNull()).select(directory_of(F.col(path)).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    climbs = dirs.select("dir", F.posexplode(above).alias("depth", "up")).join(held, "up")
    nearest = climbs.groupBy("dir").agg(F.max(F.struct("depth", "_file")).alias("_near")).select("dir", F.col("_near._file").alias("_file"))
    own = found.select(F.col("path").alias("_own"), F.col("license").alias("_license"), F.col("cosine").alias("_cosine"))
    # The row travels as one struct, so its column names cannot clash with those of the joins.
    out = files.select(F.struct(*kept).alias("row"), directory_of(F.col(path)).alias("_dir"))
    out = out.join(own, F.col(f"row.{path}") == F.col("_own"), "left").join(nearest, F.col("_dir") == F.col("dir"), "left")
    mine, theirs = F.col("_own").isNotNull(), F.col("_file").isNotNull()
    return out.select(
        "row.*",
        F.coalesce("_license", "_file.license").alias("license"),
        F.col("_cosine").alias("cosine"),
        F.when(mine, "own").when(theirs, "inherited").alias("how"),
        F.when(mine, F.col("_own")).otherwise(F.col("_file.path")).alias("source_path"),
    )


def scan_tree(files: DataFrame, path: str = "path", text: str = "text", templates: Mapping[str, str] = TEMPLATES, min_cosine: float = MIN_COSINE, file_words: int = FILE_WORDS) -> DataFrame:
    """``scan`` and ``inherit`` in one.

    Its directory's licence file is a file with a notice that is named like one (``FILE_NAME``), is itself a
    license, or has at most ``file_words`` words.
    """
    found = written(_hits(files, path, text, templates, min_cosine), "licenses")
    short = files.where(F.size(F.split(F.coalesce(text, F.lit("")), "\\s+")) <= file_words).select(F.col(path).alias("path")).distinct()
    named = found.where(F.col("whole") | F.col("path").rlike(FILE_NAME)).select("path")
    return inherit(files.drop(text), found, found.join(short.union(named).distinct(), "path"), path)
