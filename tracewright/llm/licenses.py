"""Licence scan: sparse TF-IDF cosine of the lines of a text to licence templates, then
inheritance from the nearest ancestor folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.common import words
from tracewright.plans.tables import materialize

# Short notices by which files name their licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved."),
]
# punctuation, and the signs that start, go on or end a comment
_STRIP = b".,;:!?\"'()[]{}#/*-<>=%|+~_`"


def terms(text: str | None) -> list[bytes]:
    return [t for t in (w.strip(_STRIP) for w in words(text)) if t]


@dataclass(frozen=True)
class Scan:
    """A line, or two neighbouring lines, with cosine ``least`` or more to a template states its
    licence. Of equal cosines the first template counts. A word weighs ``other`` at
    most, as an unknown one in a table of 80 texts, so that a word beside a statement weighs no more in a larger table."""
    templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)
    least: float = 0.75
    other: float = 5.4


class Matcher:
    """Templates as unit TF-IDF vectors over their own terms. All other words share one high
    weight, so a sentence that only contains some licence words stays far away."""

    def __init__(self, scan: Scan, n_docs: int, df: np.ndarray):
        self.scan, self.index = scan, vocabulary(scan)
        idf = np.log((n_docs + 1.0) / (df + 1.0)) + 1.0
        idf = np.append(idf, np.log(n_docs + 1.0) + 1.0)                       # last: any other word
        self.idf = np.minimum(idf, scan.other)
        rows = np.zeros((len(scan.templates), len(self.idf)))
        for i, (_, text) in enumerate(scan.templates):
            for t in terms(text):
                rows[i, self.index[t]] += 1
        rows *= self.idf
        self.vectors = rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def best(self, text: str | None) -> tuple[str, float, int] | None:
        """Licence, cosine and line of the best statement in the whole text."""
        other = len(self.idf) - 1
        lines, held, at, norm2, inside = [], [], [], [], []
        for number, line in enumerate((text or "").split("\n")):
            ids = [self.index.get(t, other) for t in terms(line)]
            if not ids:
                continue
            known = [i for i in ids if i != other]
            # words that are no template terms are taken as all different
            lines.append(number)
            counts = np.bincount(known, minlength=other)[:other] * self.idf[:other] if known else None
            held.append(counts)
            inside.append(0.0 if counts is None else float(counts @ counts))
            norm2.append(inside[-1] + (len(ids) - len(known)) * self.idf[other] ** 2)
        found = None
        for i in range(len(lines)):
            for j in (i, i + 1):
                if j == len(lines) or (held[i] is None and held[j] is None):
                    continue
                vector = held[i] if j == i or held[j] is None else held[j] if held[i] is None else held[i] + held[j]
                own = float(vector @ vector)
                full = own + norm2[i] - inside[i] + (norm2[j] - inside[j] if j > i else 0.0)
                if own < self.scan.least ** 2 * full:      # the cosine cannot exceed sqrt(own / full)
                    continue
                cosines = self.vectors[:, :other] @ vector / np.sqrt(full)
                k = int(np.argmax(cosines))
                if cosines[k] >= self.scan.least and (found is None or cosines[k] > found[1] + 1e-12):
                    found = (self.scan.templates[k][0], float(cosines[k]), lines[i])
        return found


def vocabulary(scan: Scan) -> dict[bytes, int]:
    found = sorted({t for _, text in scan.templates for t in terms(text)})
    return {t: i for i, t in enumerate(found)}


def document_frequencies(files: DataFrame, scan: Scan = Scan()) -> tuple[int, np.ndarray]:
    """Number of texts and, for every template term, of those that hold it. One row per task
    and template term reaches the sum; the terms are fixed by the templates."""
    index = vocabulary(scan)
    size = len(index)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                n += 1
                ids = {index[t] for t in map(_bare, set(words(text))) if t in index}
                total[list(ids)] += 1
        yield pd.DataFrame({"term": np.arange(-1, size), "n": np.concatenate([[n], total])})

    sums = files.select("text").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}                      # one row per template term
    return int(found.get(-1, 0)), np.array([found.get(i, 0) for i in range(size)], float)


def _bare(word: bytes) -> bytes:
    return word.strip(_STRIP)


def own_licences(files: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """path, doc_id, licence, cosine, line of every row; null licence where no statement is found."""
    n_docs, df = document_frequencies(files, scan)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(scan, n_docs, df)
        for batch in batches:
            found = [matcher.best(t) for t in batch["text"]]
            yield pd.DataFrame({
                "path": batch["path"], "doc_id": batch["doc_id"].astype("Int64"),
                "licence": [f[0] if f else None for f in found], "cosine": [f[1] if f else None for f in found],
                "line": pd.array([f[2] if f else None for f in found], "Int64")})

    return files.select("path", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        work, "path string, doc_id long, licence string, cosine double, line long")


def folder_of(path: Column) -> Column:
    """Path without its last part; an empty text for the top."""
    return F.when(path.isNotNull(), F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(""))


def ancestors(path: Column) -> Column:
    """Own folder and all above it as structs (depth, folder), the top last."""
    parts = F.split(folder_of(path), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))


def inherit(found: DataFrame, licence_file: Column) -> DataFrame:
    """Add effective licence and from_folder to ``found`` (path, doc_id, licence, ...).

    A row for which ``licence_file`` holds gives its licence to its folder (the smallest path, then
    doc_id, if there are several). A file without a statement of its own takes that of
    the nearest folder above it; files in one folder meet in joins on the path, one folder row each,
    which Spark can split, and never in a group.
    """
    giver = found.filter(licence_file & F.col("licence").isNotNull() & F.col("path").isNotNull())
    folders = giver.groupBy(folder_of(F.col("path")).alias("_folder")).agg(
        F.min_by("licence", F.struct("path", "doc_id")).alias("_given"))
    # the number of distinct folders is small against the files: walk up from folders, not files
    wanted = found.filter(F.col("licence").isNull() & F.col("path").isNotNull()).select(
        folder_of(F.col("path")).alias("_own")).distinct()
    above = wanted.select("_own", F.explode(ancestors(F.concat("_own", F.lit("/")))).alias("_a"))
    nearest = (above.join(folders, F.col("_a.folder") == F.col("_folder"))
               .groupBy("_own").agg(F.max_by(F.struct("_given", "_folder"), "_a.depth").alias("_n")))
    joined = found.join(nearest, F.col("licence").isNull() & (folder_of(F.col("path")) == F.col("_own")), "left")
    return joined.select(*found.columns, F.coalesce("licence", "_n._given").alias("effective"),
                         F.col("_n._folder").alias("from_folder"))


def scan_files(files: DataFrame, licence_file: Column, scan: Scan = Scan()) -> DataFrame:
    """Every row of ``files`` (path, doc_id, text): path, doc_id, licence, cosine, line, effective,
    from_folder. Null or empty texts have no licence of their own; a null path inherits nothing;
    repeated rows are scanned each; an empty table gives an empty result; other columns are ignored."""
    return inherit(materialize(own_licences(files, scan), "licences"), licence_file)


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / thousands / hundreds / doc_id.txt, where ids that end
    in one or two zeros lie one or two folders higher."""
    n = F.col("doc_id").cast("long")
    thousand, hundred = F.floor(n / 1000).cast("string"), F.floor(n / 100).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.when(n % 100 != 0, thousand),
                       F.when(n % 10 != 0, hundred), F.concat(n.cast("string"), F.lit(".txt")))
    return docs.select(F.when(n.isNotNull(), path).alias("path"), n.alias("doc_id"), "text")
