"""Licence scan: TF-IDF cosine of headers and licence files to templates, inherited from the nearest directory."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.llm.common import staged

#: Short notices by which each licence is recognised.
TEMPLATES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": [
        "BSD 3-Clause License",
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": [
        "MIT License",
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
#: Every template has one of these words, so a line without them is no candidate.
CUE = re.compile(r"licen[sc]e|spdx|permi(?:ssion|tted)", re.IGNORECASE)
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
LICENCE_FILE = re.compile(r"(?:^|/)(?:un)?(?:licen[sc]e|copying|copyright)(?:[.-][^/]*)?$", re.IGNORECASE)
#: Least cosine of a match, and the share of a file's words in matched lines from which it is a licence file whatever its name.
THRESHOLD, FILE_SHARE = 0.75, 0.5


def tokens(text: str) -> Counter:
    return Counter(TOKEN.findall(text.lower()))


class Matcher:
    """Sparse TF-IDF vectors of the templates; words outside them weigh as the rarest."""

    def __init__(self, templates: dict[str, list[str]], seen: dict[str, int], n_files: int) -> None:
        self.idf = {w: float(np.log((n_files + 1) / (k + 1)) + 1) for w, k in seen.items()}
        self.rare = float(np.log(n_files + 1) + 1)
        self.names, vectors = [], []
        for name in sorted(templates):
            for text in templates[name]:
                self.names.append(name)
                vectors.append(self.vector(tokens(text)))
        self.columns: dict[str, list[tuple[int, float]]] = {}
        for i, v in enumerate(vectors):
            for w, x in v.items():
                self.columns.setdefault(w, []).append((i, x))

    def vector(self, counts: Counter) -> dict[str, float]:
        raw = {w: (1 + np.log(k)) * self.idf.get(w, self.rare) for w, k in counts.items()}
        norm = float(np.sqrt(sum(x * x for x in raw.values()))) or 1.0
        return {w: float(x) / norm for w, x in raw.items()}

    def best(self, text: str) -> tuple[str, float] | None:
        score = np.zeros(len(self.names))
        for w, x in self.vector(tokens(text)).items():
            for i, y in self.columns.get(w, ()):
                score[i] += x * y
        top = int(np.argmax(score))
        return (self.names[top], float(score[top])) if score[top] > 0 else None


def find_licence(text: str, path: str, matcher: Matcher, threshold: float) -> tuple[str | None, float | None, int | None, bool]:
    """(licence, cosine, start of the line or 0 for the whole text, is a licence file) of one file."""
    named = bool(LICENCE_FILE.search(path))
    best: tuple[str | None, float | None, int | None] = (None, None, None)
    matched = 0
    if CUE.search(text):
        at = 0
        for line in text.split("\n"):
            if CUE.search(line) and (hit := matcher.best(line)) and hit[1] >= threshold:
                matched += len(line.split())
                if best[1] is None or hit[1] > best[1]:
                    best = (hit[0], hit[1], at)
            at += len(line) + 1
        if named and (hit := matcher.best(text)) and hit[1] >= threshold and (best[1] is None or hit[1] > best[1]):
            best = (hit[0], hit[1], 0)
    return *best, best[0] is not None and (named or matched >= FILE_SHARE * len(text.split()))


def scan_licences(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, licence, found, cosine, start, from_dir) per file.

    ``found`` is "own" (a line of the file matches a template; the best, then the first, counts), "inherited" (the nearest
    ancestor directory, its own one included, that holds a licence file), or "none". Word weights are counted over all
    files, for the templates' words only. Of several licence files in a directory the best match counts, then the name.

    * null and empty texts have no licence of their own and may inherit; a null path is the file "" in the root
    * every line of a text of any length is looked at; repeated rows are scanned each
    * directories are resolved once each, so a directory with a third of all files costs one path; files meet them by a join
      that adaptive execution can split
    * an empty table gives an empty result; other columns are ignored
    """
    templates = templates or TEMPLATES
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in tokens(t)})
    rows = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    place = {w: i for i, w in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in set(TOKEN.findall(text.lower())) & place.keys():
                    seen[place[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(vocabulary)), -1], pa.int32()), pa.array([*seen.tolist(), n], pa.int64())], ["word", "k"])

    counts = {r["word"]: r["k"] for r in rows.select("text").mapInArrow(count, "word int, k long").groupBy("word").agg(F.sum("k").alias("k")).collect()}
    matcher = Matcher(templates, {w: counts.get(i, 0) for w, i in place.items()}, counts.get(-1, 0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_licence(t, p, matcher, threshold) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "path", "own", "cosine", "start", "is_file"])

    own = staged(
        rows.mapInArrow(scan, f"id {kind}, path string, own string, cosine double, start int, is_file boolean")
        .withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    )
    held = own.where("is_file").groupBy(F.col("dir").alias("from_dir")).agg(F.min_by("own", F.struct(-F.col("cosine"), "path", "own")).alias("dir_licence"))
    levels = F.split("dir", "/")
    ancestors = F.concat(F.transform(F.sequence(F.lit(1), F.size(levels)), lambda k: F.array_join(F.slice(levels, 1, k), "/")), F.array(F.lit("")))
    nearest = staged(  # written: the join below can then be split where a directory holds much
        own.where("own is null").select("dir").distinct().select("dir", F.explode(F.array_distinct(ancestors)).alias("from_dir"))
        .join(held, "from_dir")
        .groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_licence"), F.length("from_dir")).alias("up"))
    )
    return own.join(nearest, "dir", "left").select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("own", F.col("up.dir_licence")).alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("found"),
        "cosine",
        "start",
        F.when(F.col("own").isNull(), F.col("up.from_dir")).alias("from_dir"),
    )
