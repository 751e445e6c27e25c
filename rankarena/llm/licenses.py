"""License scan with DataFrame functions only: TF-IDF cosine of notices to templates, then inheritance by directories.

Of each text that speaks of a licence these parts are scored: every line that does, alone and with its neighbours (wrapped
headers); and, as blocks, the comment it opens with, the text from its first notice on, and the whole. Terms are weighted by
frequency and by inverse frequency over the texts that speak of a licence, and a part's cosine with each template is a
join on terms, so only terms that occur are ever multiplied. Blocks meet whole licences, lines meet headers and titles;
a title without a version names no version. What a text declares by SPDX expressions of known identifiers counts first, all
of them together, then a whole licence, a header, a title; among those of one kind the most similar counts, if similar
enough. An expression with an unknown identifier counts last, as ``LicenseRef-`` and that, and isn't inherited. A licence file speaks for
its directory: a text with a licence whose file is named as one, or that opens with a notice (after blank lines or a
heading set off by one) and of whose terms notices of licences make at least ``SHARE``. Texts without a licence of their own
inherit from the nearest directory above them that has one: this is worked out once for each directory and then joined.

Defined results: a null or empty text has no notice. Equal similarities go to the first template by name; of several
licence files in a directory the most similar one counts, then the first by name. A null path has no directory and
inherits nothing. Repeated rows are treated alike.
"""

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankarena.sources.scratch import written

SIMILARITY = 0.6
#: Whole licences differ by a few words only, and so do titles.
LEAST_OF_BODIES = LEAST_OF_TITLES = 0.8
#: Lines before and behind a notice that are taken with it.
NEIGHBOURS = ((0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 0), (1, 1), (1, 2), (1, 3))
#: Of the terms of a licence file whose name doesn't tell, so many belong to notices.
SHARE = 0.5

# Whole licences are the files of this folder, named by their identifiers.
BODIES = Path(__file__).with_name("license_texts")


def _gnu(name: str, version: str) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
            f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")


_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_VERSIONS = [("GPL", "1"), ("GPL", "2"), ("GPL", "3"), ("LGPL", "2"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")]
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

# Openings of licence notices.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license: redistribution and use in source and binary forms are permitted."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *[(f"{k}-{v if '.' in v else v + '.0'}", _gnu(_GNU[k], v)) for k, v in _VERSIONS],
    *[(f"{k}-{v if '.' in v else v + '.0'}", f"This work is licensed under the {_GNU[k]}, version {v}.") for k, v in _VERSIONS],
    *[(f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for k in _CC for v in ("3.0", "4.0")],
    *[(f"CC-{k}-{v}", f"This work is licensed under the Creative Commons {name} license CC {k} {v}.") for k, name in _CC.items() for v in ("3.0", "4.0")],
    *[(f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in _CC.items()],
]
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0"), ("MIT", "The MIT License"), ("MIT", "MIT License"), ("ISC", "ISC License"), ("Zlib", "zlib License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("EPL-2.0", "Eclipse Public License v 2.0"), ("BSL-1.0", "Boost Software License Version 1.0"),
    ("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License"),
    *[(f"{k}-{v if '.' in v else v + '.0'}", f"{_GNU[k]} Version {v}") for k, v in _VERSIONS],
]
_OPENINGS = r"licen[sc]e|copyright|spdx|permission (?:is hereby granted|to use, copy)|redistribution and use|unencumbered software|without any express or implied"
NOTICE = f"(?i){_OPENINGS}"
_IDENTIFIER = r"\(?[a-z0-9][a-z0-9.+-]*\)?"
SPDX = rf"(?i)SPDX-License-Identifier:[^\S\n]*({_IDENTIFIER}(?:[^\S\n]+(?:AND|OR|WITH)[^\S\n]+{_IDENTIFIER})*)"
#: Texts that a task cuts into parts.
TEXTS_PER_TASK = 256
#: Lines of comments.
COMMENT = r"^\s*(?:$|#|//|/\*|\*|--|;|%|<!--|\.\.)"
TERM = r"[a-z0-9.]*[a-z0-9]"
#: A notice on the first line that isn't blank, or on the next one after a heading and a blank line.
OPENING = r"(?i)\A\s*+(?:[^\n]++\n[^\S\n]*+\n\s*+)?[^\n]*(?:" + _OPENINGS + ")"
#: Names of licence files; source files may be called so, too.
FILE_NAME = r"(?i)(^|[-_./])(un)?(licen[sc]es?|copying|copyright|copyleft|notice)([-_.][^/]*)?$"
SOURCE_NAME = r"(?i)\.(py|c|cc|cpp|h|hpp|cs|go|java|js|jsx|kt|php|pl|rb|rs|scala|sh|swift|ts|tsx|json|toml|xml|ya?ml)$"


def _terms(text):  # noqa: ANN001, ANN202
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def notices(docs: DataFrame, *, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, line, span, block, terms): parts that speak of a licence; ``span`` are lines, ``block`` is true for blocks.

    Parts are cut inside of the row, so that no line is there more often than the parts it is in.
    """
    split = docs.where(F.col(text_col).rlike(NOTICE)).select(*keys, F.col(text_col).alias("_text"), F.split(text_col, "\n").alias("_lines"))
    numbers = F.sequence(F.lit(0), F.size("_lines") - 1)
    count = F.size("_lines")
    code = F.array_position(F.transform("_lines", lambda x: ~x.rlike(COMMENT)), True).cast("int")
    comment = F.when(F.col("_lines")[0].rlike(r"^\s*/\*"), F.regexp_extract("_text", r"(?s)\A\s*+/\*(.*?)\*/", 1)).when(
        code > 1, F.array_join(F.slice("_lines", F.lit(1), code - 1), "\n")
    )

    def part(line: Column, span: Column, text: Column, block: bool) -> Column:
        return F.struct(line.alias("line"), span.alias("span"), text.alias("part"), F.lit(block).alias("block"))

    def near(at: Column) -> Column:
        return F.array(*[
            # A window that begins with the line before is the window of that line, if it speaks of a licence, too.
            F.when(
                (at >= before) & (at + after < count) & (F.lit(True) if not before else ~F.get("_lines", at - 1).rlike(NOTICE)),
                part(at - before, F.lit(before + after + 1), F.array_join(F.slice("_lines", at - before + 1, before + after + 1), "\n"), False),
            )
            for before, after in NEIGHBOURS
        ])

    lines = split.withColumn("_at", F.filter(numbers, lambda k: F.col("_lines")[k].rlike(NOTICE)))
    # A notice that is wrapped has its keyword on any of its lines; without such a line the whole text remains.
    first = F.coalesce(F.get("_at", F.lit(0)), F.lit(0))
    blocks = F.array(
        part(F.lit(0), count, F.col("_text"), True),
        part(first, count - first, F.when(first > 0, F.array_join(F.slice("_lines", first + 1, count), "\n")), True),
        part(F.lit(0), F.lit(0), comment, True),
    )
    parts = lines.select(*keys, F.explode(F.concat(blocks, F.flatten(F.transform("_at", near)))).alias("p")).select(*keys, "p.*")
    return parts.where("part IS NOT NULL").select(*keys, "line", "span", "block", _terms(F.col("part")).alias("terms"))


def known_identifiers() -> list[str]:
    """Identifiers of all templates, those of the GNU licences also with what later versions of them mean."""
    names = {name for name, *_ in template_terms()}
    gnu = {f"{name}-{which}" for name in names if re.match(r"[AL]?GPL-", name) for which in ("only", "or-later")}
    return sorted(names | gnu | {name + "+" for name in names if re.match(r"[AL]?GPL-", name)})


def declared_licenses(texts: DataFrame) -> DataFrame:
    """(h, license, kind): what a text declares by SPDX expressions, all of them in their order, each once.

    Kind 4 are expressions of known identifiers, and 0 the first other one as ``LicenseRef-`` and itself.
    """
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)))
    known = F.array(*[F.lit(name.lower()) for name in known_identifiers()])

    def names(expression: Column) -> Column:
        # Without parentheses, operators and exceptions.
        plain = F.regexp_replace(F.regexp_replace(F.lower(expression), r"[()]", ""), r"\s+with\s+\S+", "")
        return F.split(plain, r"\s+(?:and|or)\s+")

    def is_known(expression: Column) -> Column:
        return F.size(F.array_except(names(expression), known)) == 0

    def bracketed(expression: Column) -> Column:
        alone = (F.size("_known") == 1) | ~expression.rlike(r"(?i)\s+OR\s+") | expression.rlike(r"^\([^()]*\)$")
        return F.when(alone, expression).otherwise(F.concat(F.lit("("), expression, F.lit(")")))

    rows = texts.where(F.col("text").rlike(SPDX)).select("h", F.filter(found, is_known).alias("_known"), F.filter(found, lambda e: ~is_known(e)).alias("_other"))
    whole = F.array_join(F.transform("_known", bracketed), " AND ")
    first = F.concat(F.lit("LicenseRef-"), F.trim(F.regexp_replace(F.get("_other", F.lit(0)), r"[^A-Za-z0-9.-]+", "-")))
    return rows.select(
        "h", F.when(F.size("_known") > 0, whole).otherwise(first).alias("license"), F.when(F.size("_known") > 0, 4).otherwise(0).alias("kind")
    )


def template_terms() -> list[tuple[str, int, int, str, int]]:
    """(license, kind, number, term, frequency): kind 3 are whole licences, 2 headers, 1 titles. A table of fixed size."""
    bodies = [(f.name.removesuffix(".txt"), 3, f.read_text()) for f in sorted(BODIES.glob("*.txt"))]
    forms = [*bodies, *[(k, 2, t) for k, t in HEADERS], *[(k, 1, t) for k, t in TITLES]]
    return [(k, kind, n, term, tf) for n, (k, kind, text) in enumerate(forms) for term, tf in Counter(re.findall(TERM, text.lower())).items()]


def _idf(by_text: DataFrame, total: DataFrame) -> DataFrame:
    counted = by_text.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))
    return counted.select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))


def similarities(found: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, line, span, block, license, kind, similarity) of each part and each template with a common term."""
    spark = found.sparkSession
    templates = spark.createDataFrame(template_terms(), "license string, kind int, number int, term string, tf bigint")
    part, form = [*keys, "line", "span", "block"], ["license", "kind", "number"]
    counted = found.select(*part, F.explode("terms").alias("term")).groupBy(*part, "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = written(counted, "license-terms")
    total = found.select(*keys).distinct().agg(F.count(F.lit(1)).alias("total"))
    by_text = terms.where("block").select(*keys, "term").distinct()
    idf = written(_idf(by_text, total), "license-idf")
    rare = F.log(1 + F.col("total")) + 1
    tf = 1 + F.log("tf")
    known = templates.join(idf, "term", "left").crossJoin(F.broadcast(total)).select(*form, "term", (tf * F.coalesce("idf", rare)).alias("t"))
    norms = known.groupBy("number").agg(F.sqrt(F.sum(F.col("t") ** 2)).alias("t_norm"))
    weighted = terms.join(idf, "term").select(*part, "term", (tf * F.col("idf")).alias("w"))
    lengths = weighted.groupBy(*part).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("w_norm"))
    met = weighted.join(F.broadcast(known.withColumn("block", F.col("kind") == 3)), ["block", "term"])
    dots = met.groupBy(*part, *form).agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("w_norm") * F.col("t_norm")), 6)
    return dots.join(lengths, part).join(F.broadcast(norms), "number").select(*part, "license", "kind", cosine.alias("similarity"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: identifier, path, ``license``, ``similarity`` and ``origin`` (own, inherited, none)."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.regexp_extract(path_col, "^(.*)/", 1).alias("dir"),
        F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"),
    )
    # Equal texts have equal notices: each text is looked at once.
    once = rows.where(F.col("text").rlike(NOTICE)).groupBy("h").agg(F.first("text").alias("text"))
    speaking = written(once, "license-texts")
    # A text is a short row but makes many: without dealing, all would come from a few tasks.
    dealt = speaking.repartition(1 + speaking.count() // TEXTS_PER_TASK)
    texts = written(notices(dealt, text_col="text", keys=["h"]), "license-parts")
    bound = F.when(F.col("kind") == 3, LEAST_OF_BODIES).when(F.col("kind") == 1, LEAST_OF_TITLES).otherwise(least)
    scored = similarities(texts, keys=["h"]).where(F.col("similarity") >= bound)
    # A header or title stands for a version only if it names that.
    version = F.regexp_extract("license", r"-([0-9.]+)$", 1)
    names = F.arrays_overlap("terms", F.array(version, F.regexp_replace(version, r"\.0$", ""), F.concat(F.lit("v"), version)))
    named = (F.col("kind") == 3) | (version == "") | names
    scored = scored.join(texts, ["h", "line", "span", "block"]).where(named).drop("terms")
    declared = declared_licenses(speaking).select(
        "h", F.lit(0).alias("line"), F.lit(1).alias("span"), F.lit(False).alias("block"), "license", "kind", F.lit(1.0).alias("similarity")
    )
    scored = written(scored.unionByName(declared), "license-scores")
    # The smallest: the better kind, then the more similar, the first by name, the earlier and shorter part.
    order = F.struct((-F.col("kind")).alias("k"), (-F.col("similarity")).alias("s"), "license", "line", "span")
    own = scored.groupBy("h").agg(F.min(order).alias("o")).select("h", "o.license", (-F.col("o.s")).alias("similarity"), (F.col("o.k") < 0).alias("known"))
    passed = scored.where("kind > 0").select("h", "line", "span", "block").distinct().join(texts, ["h", "line", "span", "block"])
    sizes = F.size("terms")
    covered = passed.groupBy("h").agg(
        F.greatest(F.max(sizes), F.coalesce(F.sum(F.when((F.col("span") == 1) & ~F.col("block"), sizes)), F.lit(0))).alias("covered")
    )
    mostly = F.col("covered") >= SHARE * F.size(_terms(F.col("text")))
    whole = speaking.where(F.col("text").rlike(OPENING)).join(covered, "h").select("h", mostly.alias("mostly"))
    found = rows.drop("text").join(own.join(whole, "h", "left"), "h", "left")

    named = F.col("path").rlike(FILE_NAME) & ~F.col("path").rlike(SOURCE_NAME)
    speaks = found.where(F.col("known") & F.col("path").isNotNull() & (named | F.coalesce("mostly", F.lit(False))))
    by_dir = speaks.groupBy("dir").agg(F.min(F.struct(-F.col("similarity"), "license")).alias("best")).select(
        F.col("dir").alias("above"), F.col("best.license").alias("inherited"), F.lit(True).alias("_known")
    )
    dirs = rows.where("path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    depth = F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")
    above = dirs.select("dir", parts.alias("parts"), depth).select(
        "dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("above")
    )
    nearest = above.join(by_dir, "above").groupBy("dir").agg(F.max_by("inherited", "depth").alias("inherited"))
    whole = found.join(nearest, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("path").isNotNull() & F.col("inherited").isNotNull(), "inherited")
    return whole.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col),
        F.coalesce("license", F.when(F.col("path").isNotNull(), F.col("inherited"))).alias("license"),
        "similarity", F.coalesce(origin, F.lit("none")).alias("origin"),
    )
