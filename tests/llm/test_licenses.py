"""Whole license texts by their names, or none."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import licenses

SYSTEM = Path("/usr/share/common-licenses")
WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0",
         "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0",
         "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
RESERVED = "Copyright (c) 2020 Jane Doe. All rights reserved.\n\n"
TERMS = "\n1. Redistributions of source code must retain the above copyright notice.\n2. In binary form too.\n"


def passage(name, i=0):
    return " ".join({**licenses.IMPLIED, **licenses.PASSAGES}[name][i].split())


def notice(kind, which, version, sep=";"):
    return " ".join(licenses._GNU.format(kind, sep, which, "," if sep == ":" else ";", version).split())


CASES = [
    (notice("program", "Affero ", 3, ":"), "AGPL-3.0"), (notice("program", "", 3, ":"), "GPL-3.0"),
    (notice("program", "", 2), "GPL-2.0"), (notice("program", "", 1), "GPL-1.0"),
    (notice("library", "Lesser ", "2.1"), "LGPL-2.1"), (notice("library", "Lesser ", 3, ":"), "LGPL-3.0"),
    (notice("library", "Library ", 2), "LGPL-2.0"), (passage("MPL-1.1"), "MPL-1.1"), (passage("MPL-2.0"), "MPL-2.0"),
    (RESERVED + passage("BSD-2-Clause") + TERMS + AS_IS, "BSD-2-Clause"),
    (RESERVED + passage("BSD-2-Clause") + TERMS + passage("BSD-3-Clause") + AS_IS, "BSD-3-Clause"),
    (RESERVED + passage("BSD-2-Clause") + TERMS + passage("BSD-4-Clause") + AS_IS, "BSD-4-Clause"),
    ("ISC License\n\n" + RESERVED + passage("ISC") + AS_IS, "ISC"), (RESERVED + passage("MIT") + AS_IS, "MIT"),
    (passage("Unlicense") + " Anyone is free to copy it.", "Unlicense"), (passage("Zlib"), "Zlib"),
    ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"),
    ("A. HISTORY\n" + RESERVED + "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2\n" + AS_IS, "PSF-2.0"),
    (RESERVED + "Permission to use, copy, modify this work for study alone is given.", None),
    (RESERVED + "Redistribution and use in source and binary forms are permitted to my friends.", None),
    (RESERVED, "Proprietary"), ("Some words about gardens and rivers.", None)]


def test_licenses_by_their_words(spark):
    df = spark.createDataFrame([(i, f"d{i}/LICENSE", t) for i, (t, _) in enumerate(CASES)], "id long, path string, text string")
    got = {r.id: r.license for r in licenses.scan(df).collect()}
    assert got == {i: name for i, (_, name) in enumerate(CASES)}


@pytest.mark.skipif(not SYSTEM.exists(), reason="no license texts on this machine")
def test_whole_license_texts(spark):
    files = [(n, SYSTEM / n) for n in WHOLE if (SYSTEM / n).exists()]
    df = spark.createDataFrame([(i, f"{n}/LICENSE", p.read_text(errors="replace")) for i, (n, p) in enumerate(files)],
                               "id long, path string, text string")
    got = {files[r.id][0]: r.license for r in licenses.scan(df).collect()}
    assert got == {n: WHOLE[n] for n, _ in files}


def test_near_templates_are_told_in_place(spark):
    """A text makes a row per template that it is near to, not one per term that a template has."""
    texts = [passage("MIT"), passage("ISC"), "the software and the of a license", "roses"]
    files = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "_row long, text string, is_license boolean")
    vectors = licenses.template_vectors(files, licenses.TEMPLATES)[0].filter("kind = 'run'").cache()
    words = files.select("_row", F.array_distinct(licenses._words(F.col("text"))).alias("words"))
    got = {r[0]: sorted(t["template"] for t in r[1]) for r in words.select(
        "_row", licenses.near_templates(F.col("words"), vectors)).collect()}
    rows = vectors.collect()
    for row, held in words.collect():
        mass, least = {}, {r["template"]: r["least"] for r in rows}
        for r in rows:
            mass[r["template"]] = mass.get(r["template"], 0) + (r["unit"] ** 2 if r["term"] in held else 0)
        assert got[row] == sorted(t for t, m in mass.items() if m >= least[t] ** 2 - 1e-6)
    near = licenses.window_matches(files, vectors, vectors.groupBy("term").agg(F.max("idf").alias("idf")), 1.0)
    assert {r["license"] for r in near.collect()} >= {"MIT", "ISC"}
