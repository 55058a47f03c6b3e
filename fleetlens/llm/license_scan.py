"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

1. Document frequencies of the templates' words are counted over all documents; a word outside the
   templates weighs as much as one that no document has.
2. Every line of a text that holds a marker word (licence, copyright, SPDX, ...) is a header
   candidate and is compared, as a sparse TF-IDF vector, with all templates; so is the whole text of
   a file with such a line. The best cosine of at least ``LEAST_HEADER`` names the file's licence. A
   file is a licence file of its directory if its name says so or its whole text reaches
   ``LEAST_FILE``.
3. A file without a licence of its own takes that of the licence file in the nearest directory
   above it: the directories' ancestor paths are joined with the directories of licence files and
   the deepest match stays. Directories are joined first, files then by their own directory.

Defined results: a null or empty text has no licence of its own; a null path belongs to the root
directory; several licence files in one directory: the best score counts, then the smaller licence
name; repeated rows are judged one by one; an empty table gives an empty result; further columns
pass through, and ones named like result columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import textkit as K
from fleetlens.llm.decontaminate import Windows

LEAST_HEADER = 0.55
LEAST_FILE = 0.6

# Licence notices and openings of licence texts, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2, June 1991",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Words that make a line a header candidate, and names of licence files.
MARKERS = ["license", "licence", "licensed", "licenced", "licenses", "spdx", "copyright", "permission", "redistribution", "unencumbered", "waived"]
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|copyright|unlicense)([.-][^/]*)?$"


class Scanner:
    """Weighted template vectors over the templates' vocabulary."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.names = [k for k, v in templates.items() for _ in (*v, 0)]
        texts = [t for k, v in templates.items() for t in (*v, f"SPDX-License-Identifier: {k}")]
        items = [(str(i), t) for i, t in enumerate([*texts, " ".join(MARKERS)])]
        self.words = Windows(items)  # its sorted vocabulary and symbol lookup
        size = len(self.words.vocabulary) + 1
        self.raw = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            np.add.at(self.raw[i], self._symbols(t), 1)
        self.marker = np.zeros(size, bool)
        self.marker[self._symbols(" ".join(MARKERS))] = True
        self.marker[0] = False

    def _symbols(self, text: str) -> np.ndarray:
        _, _, low, starts, ends, _ = next(self.read(pa.array([text])))
        return self.words.symbols(K.word_hashes(low, starts, ends))

    def read(self, col: pa.Array):
        for lo, hi, buf, offs in K.text_chunks(col):
            low = K.LOWER[buf]
            yield lo, hi, low, *K.word_spans(low, offs, K.ALNUM_WORD)

    def weigh(self, df: np.ndarray, n: int) -> None:
        """Set the idf weights from document frequencies (symbol 0: words outside the templates)."""
        self.idf = np.log((1 + n) / (1 + df)) + 1
        self.idf[0] = np.log(1 + n) + 1
        t = self.raw * self.idf
        self.vectors = t / np.linalg.norm(t, axis=1, keepdims=True)

    def best(self, symbols: np.ndarray, hashes: np.ndarray) -> tuple[str, float]:
        """Closest template of a piece of text, and the cosine."""
        v = np.bincount(symbols, minlength=len(self.idf)) * self.idf
        outside = np.unique(hashes[symbols == 0], return_counts=True)[1] * self.idf[0]
        v[0] = 0.0
        size = np.sqrt(v @ v + outside @ outside)
        cosine = self.vectors @ v / (size or 1.0)
        k = int(np.argmax(cosine))
        return self.names[k], float(cosine[k])


def _frequency_task(scanner: Scanner):
    def task(batches):
        df, n = np.zeros(len(scanner.words.vocabulary) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, low, starts, ends, bounds in scanner.read(batch.column("__text")):
                symbols = scanner.words.symbols(K.word_hashes(low, starts, ends))
                met = np.unique(K.row_of(bounds) * len(df) + symbols)
                df += np.bincount(met % len(df), minlength=len(df))
        at = np.flatnonzero(df[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["symbol", "n"])
    return task


def _scan_task(scanner: Scanner, own: list[str]):
    def task(batches):
        for batch in batches:
            names, scores, whole = [None] * batch.num_rows, [0.0] * batch.num_rows, [0.0] * batch.num_rows
            for lo, _, low, starts, ends, bounds in scanner.read(batch.column("__text")):
                hashes = K.word_hashes(low, starts, ends)
                symbols = scanner.words.symbols(hashes)
                marks = np.flatnonzero(scanner.marker[symbols])
                line = np.searchsorted(np.flatnonzero(low == 0x0A), starts)  # newlines before each word
                row = K.row_of(bounds)
                for r in np.unique(row[marks]).tolist():
                    a, b = bounds[r], bounds[r + 1]
                    best = full = scanner.best(symbols[a:b], hashes[a:b])
                    for k in np.unique(line[marks[(marks >= a) & (marks < b)]]).tolist():
                        x, y = a + np.searchsorted(line[a:b], [k, k + 1])
                        best = max(best, scanner.best(symbols[x:y], hashes[x:y]), key=lambda p: p[1])
                    if best[1] >= LEAST_HEADER:
                        names[lo + r], scores[lo + r], whole[lo + r] = best[0], best[1], full[1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(names, pa.string()), pa.array(scores), pa.array(whole)],
                names=[*own, "own_license", "score", "__whole"])
    return task


def _directory(path: Column) -> Column:
    """Path without its last part ('' at the root)."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, from the root ('')."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan(files: DataFrame, path: Column, text: Column, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``files`` with path, own_license, score (cosine), is_license_file,
    license and inherited_from (directory of the licence file that gave it)."""
    K.ship(files.sparkSession)
    made = ["path", "own_license", "score", "is_license_file", "license", "inherited_from"]
    own = [c for c in (keep if keep is not None else files.columns) if c not in made]
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"/+", "/"), r"^/|/$", "")
    rows = files.select(*K.named(own), clean.alias("__path"), F.coalesce(text, F.lit("")).alias("__text"))
    scanner = Scanner()
    counted = rows.select("__text").mapInArrow(_frequency_task(scanner), "symbol long, n long")
    counts = dict(counted.groupBy("symbol").agg(F.sum("n")).collect())  # one row per template word
    df = np.zeros(len(scanner.words.vocabulary) + 1)
    for symbol, n in counts.items():
        if symbol > 0:
            df[symbol] = n
    scanner.weigh(df, counts.get(-1, 0))

    passing = [*own, "__path"]
    schema = T.StructType([*(rows.schema[c] for c in passing), T.StructField("own_license", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("__whole", T.DoubleType())])
    found = rows.mapInArrow(_scan_task(scanner, passing), schema)
    is_file = F.col("own_license").isNotNull() & (F.col("__path").rlike(FILE_NAME) | (F.col("__whole") >= LEAST_FILE))
    found = K.written(found.select(*K.named(passing), _directory(F.col("__path")).alias("__dir"), "own_license", "score",
                                   is_file.alias("is_license_file")))

    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("own_license").alias("name")))
    given = found.where("is_license_file").groupBy(F.col("__dir").alias("__from")).agg(best.alias("__best"))
    given = given.select("__from", F.col("__best.name").alias("__license"))
    below = found.select("__dir").distinct().select("__dir", F.posexplode(_ancestors(F.col("__dir"))).alias("__depth", "__from"))
    nearest = below.join(given, "__from").groupBy("__dir").agg(
        F.max(F.struct("__depth", "__from", "__license")).alias("__near"))
    out = found.join(nearest, "__dir", "left")
    takes = F.col("own_license").isNull()
    return out.select(*K.named(own), F.col("__path").alias("path"), "own_license", "score", "is_license_file",
                      F.coalesce("own_license", "__near.__license").alias("license"),
                      F.when(takes, F.col("__near.__from")).alias("inherited_from"))
