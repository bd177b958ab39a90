"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance.

*Vectors.* The terms are the words of the templates. Their weights are ``tf * ln((1 + N) /
(1 + df)) + tf`` with the number of texts N and of texts with the term df counted over the
whole collection. A word that no template has counts towards a vector's length, with the
weight of a word that no text has, but points nowhere.

*Units.* A text is scanned line by line: a header is a line of it. A license file is also
scanned as a whole. And every run of as many words as a template has, across the ends of lines,
is compared with that template (`window_matches`), so that notices in paragraphs, wrapped ones
and the bodies of licenses are found. Full texts are known by their standard headers and by
passages that no other license here has (`PASSAGES`); titles (`TITLES`) are lines. The unit with
the largest cosine decides, if it is at least `THRESHOLD`; ties go to the first license by name.
Titles, tags, and runs for templates of fewer than `SHORT` words, must agree in full. Families and
versions differ by single words, so each has its own passages here: the exact one is nearest.
Words that a license shares with others of its family (`IMPLIED`) decide only where none of
those does; words that some license here unknown grants with (`GRANTS`) mean that there is a license, but
none with a name; that all rights are reserved (`RESERVED`) decides only where nothing is granted.

*Bounds.* A unit can only get there if it has one of the *leading* terms of a template, those
whose removal leaves less than the threshold of its length; other lines and texts are left out
before words are counted. By Cauchy and Schwarz, the terms that a unit has must also make up
the threshold of the template's length: texts, then stretches of twice the template's length,
that have less are left out before runs are written out. Neither changes what is found.

*Inheritance.* A file without a license of its own has the one of the license file in its
directory, or else in the nearest directory above. License files found are joined by path to
the ancestors of each distinct directory.

Everything is DataFrame functions; the templates are a parameter of bounded size, and only
what is made from them is broadcast.

Edge cases: a null text has no words and inherits. A null path has no directory and inherits
nothing. Texts of any length are scanned in whole. If a directory has several license files,
the best match counts, then the first by name. Rows that repeat are returned each.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import pick
from tallyhouse.session import materialize

# The notices that licenses ask for, and names of license files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "All rights reserved",
}
TITLES = {
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "The Apache License, Version 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
    "CC-BY-4.0": ["Attribution 4.0 International", "Creative Commons Attribution 4.0 International"],
    "CC-BY-NC-4.0": ["Attribution-NonCommercial 4.0 International",
                     "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "CC-BY-SA-4.0": ["Attribution-ShareAlike 4.0 International",
                     "Creative Commons Attribution-ShareAlike 4.0 International"],
    "ISC": ["ISC License", "The ISC License"],
    "Zlib": ["zlib License", "The zlib License"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0"],
}
_GNU = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU
{2}General Public License as published by the Free Software Foundation{3} either version {4} of the License,
or (at your option) any later version"""
PASSAGES = {
    "AGPL-3.0": [_GNU.format("program", ":", "Affero ", ",", 3),
                 "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
                 """The GNU Affero General Public License is a free, copyleft license for software and other kinds of
                 works, specifically designed to ensure cooperation with the community in the case of network
                 server software."""],
    "Artistic-1.0-Perl": [
        """The intent of this document is to state the conditions under which a Package may be copied, such that
        the Copyright Holder maintains some semblance of artistic control over the development of the package"""],
    "Artistic-2.0": [
        """This license establishes the terms under which a given free software Package may be copied, modified,
        distributed, and/or redistributed."""],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at""",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
        worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare
        Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such
        Derivative Works in Source or Object form."""],
    "BSD-4-Clause": [
        """All advertising materials mentioning features or use of this software must display the following
        acknowledgement"""],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003",
                "Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "EPL-2.0": ["Eclipse Public License - v 2.0",
                """This program and the accompanying materials are made available under the terms of the Eclipse Public
                License 2.0 which is available at"""],
    "GFDL-1.3": ["GNU Free Documentation License Version 1.3, 3 November 2008"],
    "GPL-1.0": [_GNU.format("program", ";", "", ";", 1),
                "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies."""],
    "LGPL-2.0": [_GNU.format("library", ";", "Library ", ";", 2),
                 "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-2.1": [_GNU.format("library", ";", "Lesser ", ";", "2.1"),
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "MPL-1.1": [
        """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may
        not use this file except in compliance with the License.""",
        "MOZILLA PUBLIC LICENSE Version 1.1"],
    "PSF-2.0": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software."""],
    "BSD-3-Clause": [
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission."""],
    "CC-BY-4.0": [
        """By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and
        conditions of this Creative Commons Attribution 4.0 International Public License ("Public License").""",
        "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": [
        """By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and
        conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License
        ("Public License").""",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC0-1.0": [
        """The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related
        Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original
        work of authorship and/or a database (each, a "Work").""",
        """The person who associated a work with this deed has dedicated the work to the public domain by waiving
        all of his or her rights to the work worldwide under copyright law"""],
    "GPL-2.0": [_GNU.format("program", ";", "", ";", 2),
                "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": [_GNU.format("program", ":", "", ",", 3),
                "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                """The GNU General Public License is a free, copyleft license for software and other kinds of
                works."""],
    "LGPL-3.0": [_GNU.format("library", ":", "Lesser ", ",", 3),
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                 """This version of the GNU Lesser General Public License incorporates the terms and conditions of
                 version 3 of the GNU General Public License, supplemented by the additional permissions listed
                 below."""],
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions""",
        "Licensed under the MIT License", "under the terms of the MIT License"],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at"""],
}
IMPLIED = {
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met"""],
}
#: Marks a license that has no name here.
OTHER = "(other)"
GRANTS = ["is hereby granted", "permission is granted", "permission to use, copy, modify",
          "redistribution and use in source and binary forms", "this is free software",
          "free software license", "hereby grants"]
#: How license tags in files name the licenses; `-only`, `-or-later` and `+` may follow.
SPDX = "SPDX-License-Identifier: {0}"
#: Says that nothing is granted.
RESERVED = "Proprietary"
#: Runs for a template of fewer words must agree with it in full.
SHORT = 12
_FULL = 0.999999
_TEMPLATE = ["template", "license", "kind", "size", "least"]
_IMPLIED = "~"  # ends the name of a license that a passage only implies
LICENSE_FILE = r"(?i)^(license|licence|copying|notice)(\.(txt|md))?$"
THRESHOLD = 0.7


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def template_vectors(files: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD
                     ) -> tuple[DataFrame, float, int]:
    """``template, license, kind, size, least, term, weight, unit, idf`` (what it is compared
    with, its number of words, the cosine it takes, weights, and shares of the template's
    length), the weight of an unknown word, and how many texts there are."""
    listed = [(k, v, "line", threshold) for k, v in templates.items()]
    listed += [(k, v, "line", _FULL) for k, all_ in TITLES.items() for v in all_]
    listed += [(k, v, "run", None) for k, v in templates.items()]
    listed += [(k, v, "run", None) for k, all_ in PASSAGES.items() for v in all_]
    listed += [(k + _IMPLIED, v, "run", None) for k, all_ in IMPLIED.items() for v in all_]
    listed += [(OTHER, v, "run", _FULL) for v in GRANTS]
    listed += [(k, SPDX.format(k), "run", _FULL) for k in sorted({*templates, *TITLES, *PASSAGES, *IMPLIED} - {RESERVED})]
    rows = [F.struct(F.lit(i).alias("template"), F.lit(k).alias("license"), F.lit(v).alias("text"),
                     F.lit(kind).alias("kind"), F.lit(least).cast("double").alias("least"))
            for i, (k, v, kind, least) in enumerate(sorted(listed, key=str))]
    listed = files.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    sized = listed.withColumn("words", _words(F.col("text"))).withColumn("size", F.size("words"))
    sized = sized.withColumn("least", F.coalesce("least", F.when(
        F.col("size") < SHORT, _FULL).otherwise(threshold)))
    tf = (sized.select(*_TEMPLATE, F.explode("words").alias("term"))
          .groupBy(*_TEMPLATE, "term").agg(F.count("*").alias("tf")))
    terms = sorted(r[0] for r in tf.select("term").distinct().collect())
    known = F.array(*[F.lit(t) for t in terms])
    df = (files.select(F.explode(F.array_intersect(_words(F.col("text")), known)).alias("term"))
          .groupBy("term").agg(F.count("*").alias("df")))
    n = files.count()
    unknown = math.log(1 + n) + 1
    idf = F.log((1 + F.lit(n)) / (1 + F.coalesce("df", F.lit(0)))) + 1
    each = tf.join(df, "term", "left").select(*_TEMPLATE, "term", (F.col("tf") * idf).alias("weight"),
                                              idf.alias("idf"))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template")))
    vectors = each.withColumn("unit", F.col("weight") / length)
    return materialize(vectors, "templates"), unknown, n


def _leading(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``leads``: terms without any of which no unit is as near to the template as it takes."""
    rest = Window.partitionBy("template").orderBy("unit", "term")
    below = F.sqrt(F.sum(F.col("unit") * F.col("unit")).over(rest))
    return vectors.withColumn("leads", below >= F.col("least") - 1e-9)


def leading_terms(vectors: DataFrame) -> list[str]:
    """Terms without any of which no unit can be as near as it takes to any template."""
    return sorted(r[0] for r in _leading(vectors).filter("leads").select("term").distinct().collect())


def near_templates(terms: Column, vectors: DataFrame) -> Column:
    """The templates (an array of structs) that a text with these known terms has enough of. They are
    few whatever the table, so they are a constant that each text is held against where it is:
    no row is made for a term of a text, however many texts hold one passage."""
    book: dict[int, dict] = {}
    for r in _leading(vectors).orderBy("template", "term").collect():
        one = book.setdefault(r["template"], {**{c: r[c] for c in _TEMPLATE}, "leading": [], "terms": []})
        one["terms"].append({"term": r["term"], "mass": r["unit"] ** 2})
        one["leading"] += [r["term"]] if r["leads"] else []
    kind = ("array<struct<template int, license string, kind string, size int, least double, "
            "leading array<string>, terms array<struct<term string, mass double>>>>")
    templates = F.from_json(F.lit(json.dumps(list(book.values()))), kind)

    def enough(t: Column) -> Column:
        held = F.filter(t["terms"], lambda x: F.array_contains(terms, x["term"]))
        mass = F.aggregate(held, F.lit(0.0), lambda a, x: a + x["mass"])
        return F.arrays_overlap(t["leading"], terms) & (mass >= t["least"] * t["least"] - 1e-6)

    return F.filter(templates, enough)


def line_matches(files: DataFrame, vectors: DataFrame, idf: DataFrame, unknown: float) -> DataFrame:
    """``_row, license, cosine`` of lines, and of license files as a whole."""
    leading = F.array(*[F.lit(t) for t in leading_terms(vectors)])
    lines = files.select("_row", F.posexplode(F.split("text", "\n")).alias("unit_no", "line"))
    whole = files.filter("is_license").select(
        "_row", F.lit(-1).alias("unit_no"), F.col("text").alias("line"))
    units = (lines.unionByName(whole).select("_row", "unit_no", _words(F.col("line")).alias("words"))
             .filter(F.arrays_overlap("words", leading)))
    tf = (units.select("_row", "unit_no", F.explode("words").alias("term"))
          .groupBy("_row", "unit_no", "term").agg(F.count("*").alias("tf")))
    weighted = tf.join(F.broadcast(idf), "term", "left").withColumn(
        "w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    weighted = materialize(weighted.select("_row", "unit_no", "term", "w"), "units")
    length = weighted.groupBy("_row", "unit_no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    dots = (weighted.join(F.broadcast(vectors.select("term", "template", "license", "least", "unit")), "term")
            .groupBy("_row", "unit_no", "template", "license", "least")
            .agg(F.sum(F.col("w") * F.col("unit")).alias("dot")))
    scored = dots.join(length, ["_row", "unit_no"]).withColumn(
        "cosine", F.round(F.col("dot") / F.col("len"), 9))
    return scored.filter(F.col("cosine") >= F.col("least")).select("_row", "license", "cosine")


def window_matches(files: DataFrame, vectors: DataFrame, idf: DataFrame, unknown: float) -> DataFrame:
    """``_row, license, cosine`` of runs of as many words as the template has; a shorter text is
    one run. Only stretches that have enough of a template's terms are looked at run by run."""
    parts = vectors.select(*_TEMPLATE, "term", "unit")
    enough = F.col("mass") >= F.col("least") * F.col("least") - 1e-6
    mass = F.sum(F.col("unit") * F.col("unit")).alias("mass")
    known = F.array(*[F.lit(r[0]) for r in parts.select("term").distinct().orderBy("term").collect()])
    leading = F.array(*[F.lit(t) for t in leading_terms(vectors)])
    texts = files.select("_row", _words(F.col("text")).alias("words")).filter(
        F.arrays_overlap("words", leading))
    held = texts.withColumn("terms", F.array_intersect("words", known))
    near = materialize(held.select("_row", F.explode(near_templates(F.col("terms"), vectors)).alias("t"))
                       .select("_row", *[f"t.{c}" for c in _TEMPLATE]).distinct(), "near-templates")
    held = materialize(texts.join(near.select("_row").distinct(), "_row", "left_semi")
                       .dropDuplicates(["_row"]), "near-texts")
    # A run that starts in one cell of `size` words ends in it or in the next.
    places = (held.select("_row", F.posexplode("words").alias("pos", "term"))
              .join(F.broadcast(parts.select("term", "template", "unit")), "term")
              .join(near, ["_row", "template"]))
    cell = F.floor(F.col("pos") / F.col("size")).cast("int")
    cells = (places.select("_row", *_TEMPLATE, "term", "unit", F.explode(F.array(cell - 1, cell)).alias("cell"))
             .filter("cell >= 0").distinct().groupBy("_row", *_TEMPLATE, "cell").agg(mass).filter(enough))
    first = F.col("cell") * F.col("size")
    spans = cells.join(held, "_row").select(
        "_row", *_TEMPLATE, first.alias("first"),
        F.least(F.col("size") - 1, F.greatest(F.size("words") - F.col("size"), F.lit(0)) - first).alias("last"),
        F.slice("words", first + 1, 2 * F.col("size")).alias("span"))
    runs = (spans.filter("last >= 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("last"))))
            .select("_row", *_TEMPLATE, (F.col("first") + F.col("at")).alias("start"),
                    F.explode(F.slice("span", F.col("at") + 1, F.col("size"))).alias("term")))
    tf = runs.groupBy("_row", *_TEMPLATE, "start", "term").agg(F.count("*").alias("tf"))
    weighted = (tf.join(F.broadcast(idf), "term", "left")
                .join(F.broadcast(parts.select("template", "term", "unit")), ["template", "term"], "left")
                .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown))))
    scored = weighted.groupBy("_row", *_TEMPLATE, "start").agg(F.round(
        F.sum(F.col("w") * F.coalesce("unit", F.lit(0.0)))
        / F.sqrt(F.sum(F.col("w") * F.col("w"))), 9).alias("cosine"))
    return scored.filter(F.col("cosine") >= F.col("least")).select("_row", "license", "cosine")


def matches(files: DataFrame, templates: dict[str, str] = TEMPLATES,
            threshold: float = THRESHOLD) -> DataFrame:
    """``_row, license, cosine``: the best match of each row of
    ``files (_row, text, is_license)`` that has one."""
    vectors, unknown, _ = template_vectors(files, templates, threshold)
    idf = vectors.groupBy("term").agg(F.max("idf").alias("idf"))
    found = line_matches(files, vectors.filter("kind = 'line'"), idf, unknown).unionByName(
        window_matches(files, vectors.filter("kind = 'run'"), idf, unknown))
    # Named licenses first, then implied ones, those without a name, and reserved rights.
    weak = (F.when(F.col("license") == RESERVED, 3).when(F.col("license") == OTHER, 2)
            .when(F.col("license").endswith(_IMPLIED), 1).otherwise(0))
    best = F.min_by(F.struct("license", "cosine"), F.struct(weak, -F.col("cosine"), F.col("license")))
    return (found.groupBy("_row").agg(best.alias("b")).filter(F.col("b.license") != OTHER)
            .select("_row", F.rtrim("b.license", F.lit(_IMPLIED)).alias("license"), "b.cosine"))


def directory(path: Column) -> Column:
    """What stands before the last ``/``; empty for a name without any."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, nearest first, with the root (empty) last."""
    parts = F.split(folder, "/")
    depths = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    above = F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """``id, path, license, cosine, origin, from_path`` of every row of
    ``files (id, path, text)``.

    ``origin`` is ``own``, ``inherited`` (from the license file ``from_path``) or ``none``.
    """
    files = pick(files, "id", "path", "text")
    name = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    # A row is known by what it says; rows that say the same share their match.
    row = F.struct(F.xxhash64("path", "text").alias("a"), F.hash("text", "path").alias("b"))
    keyed = files.withColumns({"_row": row, "is_license": F.coalesce(
        name.rlike(LICENSE_FILE), F.lit(False))})
    found = materialize(matches(keyed.select("_row", "text", "is_license"), templates, threshold),
                        "licenses")
    light = keyed.select("id", "path", "_row", "is_license", directory(F.col("path")).alias("dir"))
    own = materialize(light.join(found, "_row", "left").drop("_row"), "own-licenses")
    holders = own.filter(F.col("is_license") & F.col("license").isNotNull()).groupBy(
        F.col("dir").alias("at")).agg(F.min_by(
            F.struct("license", "path"), F.struct(-F.col("cosine"), F.col("path"))).alias("h"))
    folders = own.filter(F.col("dir").isNotNull()).select("dir").distinct()
    above = folders.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("far", "at"))
    nearest = above.join(holders, "at").groupBy("dir").agg(F.min_by("h", "far").alias("h"))
    joined = own.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return joined.select(
        "id", "path", F.coalesce("license", "h.license").alias("license"), "cosine",
        F.when(mine, "own").when(F.col("h").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("h.path")).alias("from_path"))
