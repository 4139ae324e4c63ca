"""Licence scans, in DataFrame functions only.

Every line of a file, and every sentence of its paragraphs with wrapped lines put together, is
compared with licence templates (statements, standard headers, passages of licence texts, SPDX
tags) by TF-IDF cosine over sparse terms. A match counts only if both name the same licence:
the same terms out of those that tell licences apart, and nothing unknown before the word
"licence". A file made up mostly of its licence statement, or named like one, is the licence
file of its directory. Files without a statement inherit from the nearest directory above
them that has a licence file.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelltally.llm.common import let, stored, whole

GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
BSD_FORM = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:"
)
# Statements, headers and passages by which files declare common licences.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        GPL_HEADER.format("Affero General Public License", 3), "GNU Affero General Public License, Version 3, 19 November 2007",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License, Version 2.0, January 2004"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", BSD_FORM],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND-4.0": [
        "Licensed under CC BY-ND 4.0.", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, all copyright and related rights are waived."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        GPL_HEADER.format("General Public License", 2), "GNU General Public License, Version 2, June 1991",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        GPL_HEADER.format("General Public License", 3), "GNU General Public License, Version 3, 29 June 2007",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        GPL_HEADER.format("Lesser General Public License", 3), "GNU Lesser General Public License, Version 3, 29 June 2007",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
TAG = "SPDX-License-Identifier: "
# Tags of licences whose versions may be exceeded.
LATER = ("-only", "-or-later")
# Terms that tell licences apart; single digits stand for versions and clauses.
NAMING = (
    "affero", "agpl", "apache", "artistic", "boost", "bsd", "bsl", "by", "cc", "cc0", "commons", "creative", "cddl", "eclipse",
    "epl", "eupl", "gnu", "gpl", "isc", "lesser", "lgpl", "mit", "mozilla", "mpl", "nc", "nd", "noderivatives", "noderivs",
    "noncommercial", "odbl", "only", "proprietary", "sa", "sharealike", "unlicense", "wtfpl", "zlib", "0", "1", "2", "3", "4", "5",
)
# Terms that may stand before the word "licence" whatever the licence is.
BEFORE = ("a", "all", "an", "any", "applicable", "each", "following", "full", "of", "or", "other", "public", "software", "such", "that", "the", "this", "under", "your", "above")
THRESHOLD = 0.7
# Share of a file's terms in its licence statement that makes it a licence file.
MOSTLY = 0.5
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
LINE_END, SENTENCE_END = r"[\r\n]+", r"(?<=[.;!?])\s+"
# A blank line, which may have comment marks.
PARAGRAPH_END = r"\r?\n[ \t/*#;%\-]*\r?\n"
NOT_TERM = r"[^\p{L}\p{N}]+"
# Weight of a term that no template has, in units of the heaviest term that one has.
FOREIGN = 0.5
# Which option goes first: most terms of its template, then the cosine, the first segment, the first template.
ORDER = ("own", "rounded", "first", "number")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda term: term != "")


def naming(found: Column) -> Column:
    """The licence-naming terms of an array of terms, as one text."""
    return F.array_join(F.array_sort(F.array_intersect(F.array_distinct(found), F.array(*map(F.lit, NAMING)))), " ")


def before_licence(found: Column) -> Column:
    """The terms right before "licence" or "license" that may belong to a name."""
    follows = F.transform(found, lambda term, i: F.when(F.get(found, i + 1).rlike("^licen[cs]e$"), term))
    return F.array_except(F.filter(F.array_distinct(follows), lambda term: term.isNotNull()), F.array(*map(F.lit, BEFORE)))


def template_terms(templates: dict[str, list[str]]) -> list[tuple[str, int, dict[str, int]]]:
    """Licence, number and term counts of each template, tags included."""
    rows = []
    for name, texts in templates.items():
        tags = [TAG + name] + [TAG + name + later for later in LATER if "GPL" in name]
        for text in (*texts, *tags):
            cleaned = "".join(c if c.isalnum() else " " for c in text.lower()).split()
            rows.append((name, len(rows), {t: cleaned.count(t) for t in cleaned}))
    return rows


def inverse_frequencies(files: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each template term over all files. At most one number per template term is collected."""
    known = F.array(*map(F.lit, vocabulary))
    there = files.select(F.explode(F.array_intersect(terms(whole()), known)).alias("term"))
    found = {r.term: r.number for r in there.groupBy("term").agg(F.count(F.lit(1)).alias("number")).collect()}
    total = files.count()
    return {t: log((1 + total) / (1 + found.get(t, 0))) + 1 for t in vocabulary}


def decisive_terms(vectors: list[dict[str, float]], threshold: float) -> set[str]:
    """Terms of which a text must have one to reach the threshold with any template.

    The lightest terms of a template, as long as they alone stay below the threshold, can
    be left out: a text that shares only those has a smaller cosine.
    """
    kept: set[str] = set()
    for vector in vectors:
        norm, light = sqrt(sum(w * w for w in vector.values())), 0.0
        for term, weight in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            light += weight * weight
            if sqrt(light) >= threshold * norm * (1 - 1e-9):
                kept.add(term)
    return kept


def template_column(licence: str, number: int, counts: dict[str, int], vector: dict[str, float]) -> Column:
    """A template as a constant struct; its entries are those of the unit vector over its own terms."""
    norm = sqrt(sum(w * w for w in vector.values()))
    names = " ".join(sorted(set(counts) & set(NAMING)))
    entries = " ".join(repr(vector[t] / norm) for t in counts)
    return F.struct(
        F.lit(licence).alias("licence"),
        F.lit(number).alias("template"),
        F.lit(names).alias("names"),
        F.split(F.lit(" ".join(counts)), " ").alias("own"),
        F.split(F.lit(entries), " ").cast("array<double>").alias("entries"),
    )


def term_weight(term: Column, weight_of: dict[str, float], foreign: float) -> Column:
    keys = F.split(F.lit(" ".join(weight_of)), " ")
    values = F.split(F.lit(" ".join(map(repr, weight_of.values()))), " ").cast("array<double>")
    return F.coalesce(F.map_from_arrays(keys, values)[term], F.lit(foreign))


def vector_norm(found: Column, weight_of: dict[str, float], foreign: float) -> Column:
    """Length of the TF-IDF vector of an array of terms: equal terms stand together once sorted."""
    start = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("sum"))

    def square(run: Column) -> Column:
        return run["tf"] * run["weight"] * run["tf"] * run["weight"]

    def step(run: Column, term: Column) -> Column:
        more = F.struct(run["term"].alias("term"), (run["tf"] + 1).alias("tf"), run["weight"].alias("weight"), run["sum"].alias("sum"))
        weight = term_weight(term, weight_of, foreign)
        other = F.struct(term.alias("term"), F.lit(1).alias("tf"), weight.alias("weight"), (run["sum"] + square(run)).alias("sum"))
        return F.when(term == run["term"], more).otherwise(other)

    return F.aggregate(F.sort_array(found), start, step, lambda run: F.sqrt(run["sum"] + square(run)))


def options(segments: Column, table: Column, weight_of: dict[str, float], foreign: float) -> Column:
    """Cosines of a file's segments to the templates that name the same licence, as an array.

    All of it stays within the file's row: however many files share a line, nothing multiplies.
    Fields begin with those that say which option goes first.
    """

    def agreeing(s: Column) -> Column:
        read = F.struct(naming(s["terms"]).alias("names"), before_licence(s["terms"]).alias("before"))
        return let(
            read,
            lambda r: F.filter(table, lambda t: (t["names"] == r["names"]) & (F.size(F.array_except(r["before"], t["own"])) == 0)),
        )

    def cosine(s: Column, t: Column) -> Column:
        known = F.filter(s["terms"], lambda term: F.array_contains(t["own"], term))
        return F.aggregate(
            known, F.lit(0.0), lambda total, term: total + term_weight(term, weight_of, foreign) * F.get(t["entries"], F.array_position(t["own"], term).cast("int") - 1)
        ) / s["norm"]

    def option(s: Column, t: Column) -> Column:
        return let(
            cosine(s, t),
            lambda c: F.struct(
                F.size(t["own"]).alias("own"), F.round(c, 9).alias("rounded"), (-s["place"]).alias("first"), (-t["template"]).alias("number"),
                t["licence"].alias("licence"), c.alias("cosine"), s["statement"].alias("statement"), F.size(s["terms"]).alias("length"),
            ),
        )

    read = F.transform(segments, lambda s: F.struct(s["place"].alias("place"), s["statement"].alias("statement"), s["terms"].alias("terms"), agreeing(s).alias("agreeing")))
    normed = F.transform(
        F.filter(read, lambda s: F.size(s["agreeing"]) > 0),
        lambda s: F.struct(
            s["place"].alias("place"), s["statement"].alias("statement"), s["terms"].alias("terms"), s["agreeing"].alias("agreeing"),
            vector_norm(s["terms"], weight_of, foreign).alias("norm"),
        ),
    )
    return F.flatten(F.transform(normed, lambda s: F.transform(s["agreeing"], lambda t: option(s, t))))


def statements(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The best licence statement of each file that has one.

    Returns path, licence, cosine, statement and share (of the file's terms). Of several the
    one with most terms of its template wins, so that a clause which tells two licences apart
    goes before what they have in common; then the higher cosine, the first segment and the
    first licence by name.
    """
    rows = template_terms(templates)
    vocabulary = sorted({t for _, _, counts in rows for t in counts})
    weight_of = inverse_frequencies(files, vocabulary)
    vectors = [{t: n * weight_of[t] for t, n in counts.items()} for _, _, counts in rows]
    decisive = F.array(*map(F.lit, sorted(decisive_terms(vectors, threshold))))
    foreign = FOREIGN * max(weight_of.values())
    table = F.array(*(template_column(*row, vector) for row, vector in zip(rows, vectors)))
    paragraphs = F.transform(F.split(whole(), PARAGRAPH_END), lambda p: F.split(F.regexp_replace(p, LINE_END, " "), SENTENCE_END))
    pieces = F.array_distinct(F.concat(F.split(whole(), LINE_END), F.flatten(paragraphs)))
    split = F.transform(pieces, lambda s, i: F.struct(i.alias("place"), s.alias("statement"), terms(s).alias("terms")))
    segments = F.filter(split, lambda s: F.arrays_overlap(s["terms"], decisive))
    found = F.array_max(F.filter(options(segments, table, weight_of, foreign), lambda o: o["cosine"] >= threshold))
    size = F.size(terms(whole()))
    share = (F.col("o.length") / F.col("size")).alias("share")
    fields = F.struct(*(F.col(f"o.{name}") for name in ORDER), "o.licence", "o.cosine", "o.statement", share)
    # Files without a statement are dropped last: a filter on what was just made would make it twice.
    return (
        files.select(F.coalesce("path", F.lit("")).alias("path"), size.alias("size"), found.alias("o"))
        .groupBy("path")
        .agg(F.max(F.when(F.col("o").isNotNull(), fields)).alias("b"))
        .where(F.col("b").isNotNull())
        .select("path", "b.licence", "b.cosine", "b.statement", "b.share")
    )


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherited(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """For each folder the licence of the nearest one above it, itself included, that has one.

    ``licensed`` has folder, licence and licence_file, one row each.
    """
    parts = F.split("folder", "/")
    above = folders.select(
        "folder",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(parts)),
                lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")),
            )
        ).alias("a"),
    ).select("folder", "a.*")
    return (
        above.join(licensed.withColumnRenamed("folder", "above"), "above")
        .groupBy("folder")
        .agg(F.max_by(F.struct("licence", "licence_file"), "depth").alias("n"))
        .select("folder", "n.*")
    )


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, licence, cosine, statement, origin (``own``, ``inherited`` or null) and licence_file of each file.

    Needs ``path`` (parts divided by /) and ``text``. A null path is the empty one, a null
    text has no statement; both may still inherit. Repeated paths share what any of their
    rows declares. Other columns are not looked at; an empty input gives an empty result.
    """
    own = stored(statements(files, templates, threshold), "licence-statements")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    licensed = (
        own.where((F.col("share") >= MOSTLY) | name.rlike(LICENCE_NAME))
        .groupBy(directory(F.col("path")).alias("folder"))
        .agg(F.max_by(F.struct("licence", F.col("path").alias("licence_file")), F.struct(F.round("cosine", 9), "path")).alias("b"))
        .select("folder", "b.*")
    )
    paths = files.select(F.coalesce("path", F.lit("")).alias("path")).withColumn("folder", directory(F.col("path")))
    from_above = inherited(paths.select("folder").distinct(), licensed).select(
        "folder", F.col("licence").alias("above_licence"), "licence_file"
    )
    return (
        paths.join(own, "path", "left")
        .join(from_above, "folder", "left")
        .select(
            "path",
            F.coalesce("licence", "above_licence").alias("licence"),
            "cosine",
            "statement",
            F.when(F.col("licence").isNotNull(), "own").when(F.col("above_licence").isNotNull(), "inherited").alias("origin"),
            F.when(F.col("licence").isNull(), F.col("licence_file")).alias("licence_file"),
        )
    )
