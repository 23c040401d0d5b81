"""License scans (operator 6), by column expressions only.

Lines (and sentences) that hold a licence cue are sparse TF-IDF vectors, and so are the
blocks of lines around a cue, joined and without comment marks; their cosine to each
notice says which licence they name. Whole texts with a cue, and their pieces between
blank lines (a comment with its empty comment lines is one), are compared with the full
licence texts. A document takes its best hit; a named licence goes before a reservation of
all rights. A document is a licence file if its base name says so, if such lines or blocks
make up half of its words, or if it is as a whole near a licence text; it speaks for its directory, and documents without a licence of their own inherit from the
nearest directory above them that has one.
"""

from __future__ import annotations

import json
import math
import pkgutil
import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.shared import looked_up, written

#: Short notices by which the licences are named; fixed values.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
CUE = "(?i)licen[sc]e|copyright|spdx|permission is hereby granted|redistribution and use|public domain|all rights reserved"
#: The cue where its words may be on two lines, with comment marks between them.
WRAPPED_CUE = "(?i)licen[sc]e|copyright|spdx|permission\\W+is\\W+hereby\\W+granted|redistribution\\W+and\\W+use|public\\W+domain|all\\W+rights\\W+reserved"
#: Licences whose full text is in license_texts.
FULL_TEXTS = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "BSD-3-Clause", "MPL-2.0")
#: Marks at the ends of comment lines, and what parts blocks once they are gone.
MARK = "(?m)^[\\x20\\t]*(?:/\\*+|\\*+/|\\*+|//+|#+|--+|;+|%+|<!--|\"\"\"|\'\'\')[\\x20\\t]*|[\\x20\\t\\r]*(?:\\*/|-->)?[\\x20\\t\\r]*$"
BLOCK = "\\n[\\x20\\t]*\\n"
LINE = "\\n|(?<=[.!?])\\s+(?=\\p{Lu})"
TERM = "[^a-z0-9.+-]+|\\.(?=\\s|$)|[.,](?=[^0-9])"
FILE_NAME = "(?i)(^|/)(licen[sc]e|copying|notice|unlicense)(\\.[a-z]+)?$"
LEAST_COSINE, LEAST_SHARE = 0.7, 0.5
#: Least cosine of a whole text or piece, in logarithms of term counts, to a full licence text.
LEAST_WHOLE = 0.8


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9.+-]+|\.(?=\s|$)|[.,](?=[^0-9])", text.lower()) if t]


def template_vectors() -> tuple[dict[str, float], float, list[tuple[str, str, float]]]:
    """Inverse document frequencies, that of an unknown term, and (template, term, weight / norm)."""
    texts = [(name, terms_of(t)) for name, group in TEMPLATES.items() for t in group]
    seen: dict[str, int] = {}
    for _, terms in texts:
        for t in set(terms):
            seen[t] = seen.get(t, 0) + 1
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for k, (name, terms) in enumerate(texts):
        weights = {t: terms.count(t) * idf[t] for t in set(terms)}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(f"{name}#{k}", t, w / norm) for t, w in weights.items()]
    return idf, math.log(1 + len(texts)) + 1, rows


def full_text(name: str) -> str:
    return pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()


def full_vectors() -> tuple[dict[str, float], float, list[tuple[str, str, float]]]:
    """As template_vectors(), of the full texts, where a term that occurs n times counts 1 + ln(n)."""
    texts = [(name, terms_of(full_text(name))) for name in FULL_TEXTS]
    seen: dict[str, int] = {}
    for _, terms in texts:
        for t in set(terms):
            seen[t] = seen.get(t, 0) + 1
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for name, terms in texts:
        weights = {t: (1 + math.log(terms.count(t))) * idf[t] for t in set(terms)}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(f"{name}#text", t, w / norm) for t, w in weights.items()]
    return idf, math.log(1 + len(texts)) + 1, rows


class Scale:
    """Template vectors as constants that an expression looks terms up in, each term in one step.

    Terms are numbered by bucket of their checksum; ``weights`` has a row for each template.
    """

    BUCKETS = 4096

    def __init__(self, vectors: tuple[dict[str, float], float, list[tuple[str, str, float]]]):
        idf, unknown, rows = vectors
        terms = sorted(idf)
        self.templates = sorted({t for t, _, _ in rows})
        place = {t: k for k, t in enumerate(terms)}
        buckets: list[list[dict]] = [[] for _ in range(self.BUCKETS)]
        for t, k in place.items():
            buckets[zlib.crc32(t.encode()) % self.BUCKETS].append({"t": t, "k": k + 1})
        weights = [[0.0] * len(terms) for _ in self.templates]
        for name, t, w in rows:
            weights[self.templates.index(name)][place[t]] = w
        constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
        self._buckets = constant(buckets, "array<array<struct<t:string,k:int>>>")
        # Place 0 of idf, as all that follow from 1: a term that no template has.
        self._idf = constant([unknown, *(idf[t] for t in terms)], "array<double>")
        self._weights = constant(weights, "array<array<double>>")

    def weighed(self, counted: Column, tf: Callable[[Column], Column]) -> Column:
        """array<struct<k, w>> from array<struct<term, n>>: the term's number (0: unknown) and its weight."""
        bucket = lambda t: F.element_at(self._buckets, (F.crc32(t) % self.BUCKETS).cast("int") + 1)
        number = lambda t: F.coalesce(F.get(F.filter(bucket(t), lambda x: x["t"] == t), F.lit(0))["k"], F.lit(0))
        numbered = F.transform(counted, lambda c: F.struct(number(c["term"]).alias("k"), tf(c["n"]).alias("tf")))
        return F.transform(numbered, lambda c: F.struct(c["k"].alias("k"), (c["tf"] * F.element_at(self._idf, c["k"] + 1)).alias("w")))

    def best(self, weighed: Column, least: float) -> Column:
        """struct<named, cosine, template> of the nearest template, a named licence before a reservation; null if none is near."""
        norm = F.sqrt(F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
        known = F.filter(weighed, lambda x: x["k"] > 0)

        def hits(bound: Column) -> Column:
            dot = lambda j: F.aggregate(bound["known"], F.lit(0.0), lambda acc, x: acc + x["w"] * F.element_at(F.element_at(self._weights, j + 1), x["k"]))
            names = F.array(*map(F.lit, self.templates))
            named = F.array(*(F.lit(not t.startswith("proprietary")) for t in self.templates))
            scored = F.transform(F.sequence(F.lit(0), F.lit(len(self.templates) - 1)), lambda j: F.struct(F.element_at(named, j + 1).alias("named"), F.round(dot(j) / bound["norm"], 6).alias("cosine"), F.element_at(names, j + 1).alias("template")))
            return F.array_max(F.filter(scored, lambda x: x["cosine"] >= least))

        return F.when(F.size(weighed) > 0, _let(F.struct(norm.alias("norm"), known.alias("known")), hits))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))


def _counted(text: Column) -> Column:
    """array<struct<term, n>>: the distinct terms, in order, and how often each occurs."""

    def runs(terms: Column) -> Column:
        starts = F.filter(F.transform(terms, lambda t, i: F.when((i == 0) | (t != F.get(terms, i - 1)), i)), lambda i: i.isNotNull())
        return _let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(terms, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(terms)) - i).alias("n"))))

    return _let(F.array_sort(F.filter(F.split(F.lower(text), TERM), lambda t: t != "")), runs)


def with_own(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) with own, cosine and cover: the licence that a row names, or nulls.

    ``cover`` is the largest share of words in lines, in blocks or in pieces that do, 1 for
    a licence text. All of it is worked out within the row.
    """
    notices, full = Scale(template_vectors()), Scale(full_vectors())
    cued = F.col("text").rlike(WRAPPED_CUE)
    near_notice = lambda x: notices.best(notices.weighed(_counted(x), lambda n: n.cast("double")), LEAST_COSINE)
    near_full = lambda x: full.best(full.weighed(_counted(x), lambda n: 1 + F.log(n.cast("double"))), LEAST_WHOLE)
    units = {
        "lines": (F.filter(F.split("text", LINE), lambda x: x.rlike(CUE)), near_notice),
        "blocks": (F.filter(F.split(F.regexp_replace("text", MARK, ""), BLOCK), lambda x: x.contains("\n") & x.rlike(WRAPPED_CUE)), near_notice),
        "whole": (F.array("text"), near_full),
        "pieces": (F.filter(F.split("text", BLOCK), lambda x: x.contains("\n") & x.rlike(WRAPPED_CUE)), near_full),
    }
    staged = docs.withColumns({f"__{name}": F.when(cued, texts) for name, (texts, _) in units.items()})
    hits = lambda texts, near: F.filter(F.transform(texts, lambda x: F.struct(_n_words(x).alias("words"), near(x).alias("hit"))), lambda u: u["hit"].isNotNull())
    staged = staged.withColumns({f"__{name}": hits(F.col(f"__{name}"), near) for name, (_, near) in units.items()})
    best = F.array_max(F.transform(F.concat(*(F.col(f"__{name}") for name in units)), lambda u: u["hit"]))
    covered = lambda name: F.aggregate(F.col(f"__{name}"), F.lit(0), lambda acc, u: acc + u["words"])
    staged = staged.withColumns({"__hit": best, "__covered": F.greatest(*map(covered, units))})
    share = F.when(F.col("__hit").isNotNull(), F.col("__covered") / _n_words(F.col("text")))
    staged = staged.withColumns({"own": F.substring_index("__hit.template", "#", 1), "cosine": F.col("__hit.cosine"), "cover": share})
    return staged.drop("__hit", "__covered", *(f"__{name}" for name in units))


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def inherited_licenses(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, license) for each directory of ``paths`` (path) that has a licence file (path, license, cosine) in it or above it; the nearest counts."""
    spoken = files.select(_parent(F.col("path")).alias("above"), "license", "cosine").groupBy("above").agg(F.max(F.struct("cosine", "license")).alias("best"))
    # Directories are few beside documents, and a hot one is one row here.
    dirs = paths.select(_parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("depth", "above"))
    return above.join(spoken, "above").groupBy("dir").agg(F.max_by("best", "depth").alias("best")).select("dir", F.col("best.license").alias("license"))


def scan_licenses(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, cosine, inherited) for every row of ``docs``.

    ``license`` is the document's own, or that of the nearest licence file in its directory
    or above, or null. Null and empty texts have none of their own. A null path is the
    root. Repeated rows are scanned alike. Other columns are left out; texts are scanned
    whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = with_own(rows).withColumn("dir", _parent(F.col("path"))).drop("text")
    own = written(own.withColumn("file", F.coalesce(F.col("cover") >= LEAST_SHARE, F.lit(False)) | (F.col("own").isNotNull() & F.col("path").rlike(FILE_NAME))).drop("cover"), "own")
    files = own.filter("file").select("path", F.col("own").alias("license"), "cosine")
    many = own.groupBy("dir").agg(F.count("*").alias("many"))
    above = inherited_licenses(own.select("path"), files).select("dir", F.col("license").alias("from_above"))
    above = many.join(above, "dir", "left")  # each directory once, so that a hot one without licence is known too
    placed = looked_up(own, above, ["dir"], "many")
    return placed.select("doc_id", F.coalesce("own", "from_above").alias("license"), "cosine", (F.col("own").isNull() & F.col("from_above").isNotNull()).alias("inherited"))
