"""Licence scan of a file tree: TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame and SQL functions only.

Units of a file are its lines that mention a licence keyword, a short one (as wrapped notices have) also joined with the lines after
it (two to WINDOW lines together); every line of the whole file is looked at. Tags are split at hyphens, version numbers lose ``v`` and
``.0``. A unit is compared with the templates of those licences only whose family and version terms it has, and that it holds no term against (GUARDS):
a licence that is not in the list gives null, not a neighbour. Units and templates are sparse TF-IDF vectors over the templates' terms (a
unit's other terms count towards its length); a file's own licence is that of its best unit with a cosine of at least LEAST. A
licence file - its name says so, or half of its words are terms of matching units - gives its licence to its directory, and a file without
own licence inherits from the nearest ancestor directory that has one (equi-joins on directory paths).

Scale: texts are cut to units before any shuffle; the templates' vectors are a fixed small table; inheritance is resolved per distinct
directory, so that files meet one row of their directory.

Cases: null or empty text has no unit; a null path is a file outside all directories; very long texts are looked at whole; equal scores: the
licence first in the alphabet; clauses of both BSD licences: the one with more clauses; several licence files in a directory: the highest
cosine, then the first licence; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.llm.shared import written

#: (licence, its name, terms of which each group needs one, terms that it must not have). The licences' names, families and versions.
GUARDS = [
    ("AGPL-3.0", "GNU Affero General Public License, version 3", [["agpl", "affero"], ["3"]], ["1", "2"]),
    ("Apache-1.1", "Apache License, Version 1.1", [["apache"], ["1.1"]], ["2"]),
    ("Apache-2.0", "Apache License, Version 2.0", [["apache"], ["2"]], ["1.1"]),
    ("BSD-2-Clause", "BSD 2-Clause License", [["bsd", "redistribution"], ["2", "simplified", "redistribution"]], ["3", "4", "new", "neither", "advertising"]),
    ("BSD-3-Clause", "BSD 3-Clause License", [["bsd", "neither"], ["3", "new", "neither"]], ["2", "4", "advertising"]),
    ("BSL-1.0", "Boost Software License, Version 1.0", [["boost", "bsl"], ["1"]], []),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0", [["cc", "creative"], ["by", "attribution"], ["4"]],
     ["nc", "noncommercial", "commercial", "sa", "sharealike", "share", "nd", "noderivatives", "noderivs"]),
    ("CC-BY-NC-4.0", "Creative Commons Attribution NonCommercial 4.0", [["cc", "creative"], ["by", "attribution"], ["nc", "noncommercial", "commercial"], ["4"]],
     ["sa", "sharealike", "share", "nd", "noderivatives", "noderivs"]),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution NonCommercial NoDerivatives 4.0",
     [["cc", "creative"], ["by", "attribution"], ["nc", "noncommercial", "commercial"], ["nd", "noderivatives", "noderivs"], ["4"]], ["sa", "sharealike", "share"]),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution NonCommercial ShareAlike 4.0",
     [["cc", "creative"], ["by", "attribution"], ["nc", "noncommercial", "commercial"], ["sa", "sharealike", "share"], ["4"]], ["nd", "noderivatives", "noderivs"]),
    ("CC-BY-ND-4.0", "Creative Commons Attribution NoDerivatives 4.0", [["cc", "creative"], ["by", "attribution"], ["nd", "noderivatives", "noderivs"], ["4"]],
     ["nc", "noncommercial", "commercial", "sa", "sharealike", "share"]),
    ("CC-BY-SA-4.0", "Creative Commons Attribution ShareAlike 4.0", [["cc", "creative"], ["by", "attribution"], ["sa", "sharealike", "share"], ["4"]],
     ["nc", "noncommercial", "commercial", "nd", "noderivatives", "noderivs"]),
    ("CC0-1.0", "CC0 1.0 Universal", [["cc0"]], []),
    ("EPL-2.0", "Eclipse Public License, version 2.0", [["epl", "eclipse"], ["2"]], ["1"]),
    ("GPL-2.0", "GNU General Public License, version 2", [["gpl", "general"], ["2"]], ["1", "3", "lesser", "lgpl", "affero", "agpl", "library"]),
    ("GPL-3.0", "GNU General Public License, version 3", [["gpl", "general"], ["3"]], ["1", "2", "lesser", "lgpl", "affero", "agpl", "library"]),
    ("ISC", "ISC License", [["isc", "fee"]], []),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", [["lgpl", "lesser"], ["2.1"]], ["2", "3"]),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", [["lgpl", "lesser"], ["3"]], ["2", "2.1"]),
    ("MIT", "MIT License", [["mit", "free"]], ["fee"]),
    ("MPL-1.1", "Mozilla Public License, version 1.1", [["mpl", "mozilla"], ["1.1"]], ["2"]),
    ("MPL-2.0", "Mozilla Public License, version 2.0", [["mpl", "mozilla"], ["2"]], ["1", "1.1"]),
    ("Unlicense", "Unlicense", [["unlicense", "unencumbered"]], []),
    ("Zlib", "zlib License", [["zlib"]], []),
]
#: (licence, text): how files state these public licences besides their names and tags. Wording of the licences and their notices.
NOTICES = [
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution license, CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under Creative Commons Attribution NonCommercial, CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def _templates() -> list[tuple[str, str]]:
    """Of each licence its name, tag and the usual statements of both; and the notices."""
    made = []
    for licence, name, *_ in GUARDS:
        made += [(licence, t) for t in (f"SPDX-License-Identifier: {licence}", f"Licensed under {licence}", f"{name}", f"Licensed under the {name}",
                                        f"This work is licensed under the {name}", f"License: {licence}")]
    return made + NOTICES


TEMPLATES = _templates()
KEYWORDS = ("(?i)licen[cs]e|licensed|copyright|spdx|creative commons|permission is hereby|permission to use|redistribution and use|neither the name|unencumbered"
            "|general public|public domain")
LICENCE_NAMES = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)(\.[a-z]+)?$"
LEAST = 0.6
#: Lines of a wrapped notice that are joined; characters of a line that may be one of them.
WINDOW, WRAPPED = 4, 200


def _terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; version numbers keep inner dots, lose a ``v`` and a last ``.0``."""
    plain = F.regexp_replace(F.lower(text), r"(?<![a-z])v\.? ?(?=[0-9])|(?<=gpl)v(?=[0-9])", " ")
    return F.regexp_extract_all(F.regexp_replace(plain, r"([0-9])\.0(?![0-9.]*[0-9])", "$1"), F.lit(r"[a-z0-9]+(?:\.[a-z0-9]+)*"), 0)


def templates(spark, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(rows, "licence string, template string")


def _allowed(terms: Column) -> Column:
    """The licences whose family and version terms are there, and no term against them."""
    def words(x):
        return F.array(*[F.lit(t) for t in x]) if x else F.array().cast("array<string>")

    known = F.array(*[F.struct(F.lit(g[0]).alias("licence"), F.array(*[words(x) for x in g[2]]).alias("need"), words(g[3]).alias("without")) for g in GUARDS])
    fits = F.filter(known, lambda g: F.forall(g["need"], lambda x: F.arrays_overlap(terms, x)) & ~F.arrays_overlap(terms, g["without"]))
    return F.transform(fits, lambda g: g["licence"])


def headers(files: DataFrame) -> DataFrame:
    """A written table (file, line, terms, licence) of each unit and licence that fits it; ``files`` has file, text. line numbers the units of a file."""
    some = files.where(F.col("text").rlike(KEYWORDS)).select("file", "text", F.split("text", r"\n").alias("lines"))
    # a line with a keyword and the lines after it, cut out within the row
    cut = F.transform("lines", lambda x, i: F.when(x.rlike(KEYWORDS), F.struct(i.alias("at"), F.slice("lines", i + 1, WINDOW).alias("part"))))
    lines = some.select("file", F.explode(F.filter(cut, lambda x: x.isNotNull())).alias("u")).select("file", "u.at", "u.part")
    windows = lines.select("file", "at", "part", F.explode(F.sequence(F.lit(1), F.when(F.length(F.col("part")[0]) <= WRAPPED, F.size("part")).otherwise(1))).alias("w")) \
        .select("file", (F.col("at") * WINDOW + F.col("w")).cast("long").alias("line"), F.array_join(F.slice("part", 1, F.col("w")), " ").alias("content"))
    # written, so that the terms are made once and not for every term that the guards look at
    units = written(windows.select("file", "line", _terms(F.col("content")).alias("terms")), "licence-units")
    return written(units.select("file", "line", "terms", F.explode(_allowed(F.col("terms"))).alias("licence")), "licence-headers")


def _vectors(rows: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, w, norm): weights (1 + log tf) * idf and the vector's length."""
    tf = rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(F.broadcast(idf), "term", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(1.0)))
    return w


def similarities(heads: DataFrame, templ: DataFrame) -> DataFrame:
    """(file, line, licence, cosine, n_terms) of each header with its best licence."""
    t = templ.select("licence", "template", _terms(F.col("template")).alias("terms"))
    # of the templates' terms over the templates; one row a template term
    known = t.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("in_templates"))
    count = t.agg(F.count(F.lit(1)).alias("templates")).scalar()
    idf = known.select("term", (F.log((count + 1) / F.col("in_templates")) / F.log(count + 1)).alias("idf"))
    keys = ["licence", "template"]
    tv = _vectors(t, idf, keys)
    t_norm = tv.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    tv = tv.select(*keys, "term", F.col("w").alias("tw")).join(F.broadcast(t_norm), keys)
    own = ["file", "line", "licence"]
    hv = _vectors(heads, idf, own)
    # outside terms weigh little: a line may go on after the notice
    hv = hv.withColumn("w", F.when(F.col("idf").isNull(), 0.25).otherwise(F.col("w")))
    norm = hv.groupBy(*own).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("h_norm"), F.sum(F.when(F.col("idf").isNotNull(), F.col("tf")).otherwise(0)).alias("n_terms"))
    dots = hv.join(F.broadcast(tv), ["term", "licence"]).groupBy(*own, "template").agg((F.sum(F.col("w") * F.col("tw")) / F.first("t_norm")).alias("dot"))
    top = dots.groupBy(*own).agg(F.max("dot").alias("dot")).join(norm, own)
    scored = top.select(*own, F.round(F.col("dot") / F.col("h_norm"), 6).alias("cosine"), "n_terms")
    best = scored.groupBy("file", "line").agg(F.min(F.struct((-F.col("cosine")).alias("m"), "licence", "n_terms")).alias("b"))
    return best.select("file", "line", F.col("b.licence").alias("licence"), (-F.col("b.m")).alias("cosine"), F.col("b.n_terms").alias("n_terms"))


def own_licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(file, licence, cosine, header_terms) of the files with a matching header."""
    got = similarities(headers(files), templates(files.sparkSession)).where(F.col("cosine") >= least)
    best = got.groupBy("file").agg(
        F.min(F.struct((-F.col("cosine")).alias("m"), "licence")).alias("b"),
        F.min(F.when(F.col("licence") == "BSD-3-Clause", F.struct((-F.col("cosine")).alias("m"), "licence"))).alias("more"),
        # single lines or, where a notice is wrapped, its longest unit
        F.greatest(F.coalesce(F.sum(F.when((F.col("line") > 0) & (F.col("line") % WINDOW == 1), F.col("n_terms"))), F.lit(0)), F.max("n_terms")).alias("header_terms"))
    pick = F.when((F.col("b.licence") == "BSD-2-Clause") & F.col("more").isNotNull(), F.col("more")).otherwise(F.col("b"))
    return best.withColumn("b", pick).select("file", F.col("b.licence").alias("licence"), (-F.col("b.m")).alias("cosine"), "header_terms")


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def _ancestors(directory: Column) -> Column:
    """The directory itself and all above it, with their depths; the root is empty."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))


def inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """(file, path, licence, cosine, origin, from_dir): own licences, else those of the nearest ancestor directory with a licence file."""
    placed = files.select("file", "path", "n_words", _parent(F.coalesce("path", F.lit(""))).alias("dir"))
    known = placed.join(own, "file", "left")
    is_licence = F.col("path").rlike(LICENCE_NAMES) | (2 * F.col("header_terms") >= F.col("n_words"))
    given = known.where(F.col("licence").isNotNull() & F.col("path").isNotNull() & is_licence).groupBy("dir").agg(
        F.min(F.struct((-F.col("cosine")).alias("m"), "licence")).alias("b")).select(F.col("dir").alias("above"), F.col("b.licence").alias("given"))
    dirs = placed.where("path is not null").select("dir").distinct().select("dir", F.explode(_ancestors(F.col("dir"))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = dirs.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("n")) \
        .select("dir", F.col("n.given").alias("given"), F.col("n.above").alias("from_dir"))
    out = known.join(nearest, "dir", "left")
    inherits = F.col("licence").isNull() & F.col("given").isNotNull() & F.col("path").isNotNull()
    return out.select("file", "path", F.coalesce("licence", F.when(inherits, F.col("given"))).alias("licence"), "cosine",
                      F.when(F.col("licence").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
                      F.when(inherits, F.col("from_dir")).alias("from_dir"))


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, least: float = LEAST) -> DataFrame:
    """(id, path, licence, cosine, origin, from_dir) of each row of a table of files."""
    # rows that repeat an id, path and text act as one file
    rows = files.select(F.struct(F.col(id_col).alias("id"), F.col(path_col).alias("p"), F.xxhash64(text_col).alias("h")).alias("file"),
                        F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    slim = rows.select("file", "path", F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")).alias("n_words"))
    copies = slim.groupBy("file", "path", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    own = own_licences(rows.select("file", "text"), least)
    out = inherit(copies, own).join(copies.select("file", "copies"), "file")
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")) \
        .select(F.col("file.id").alias(id_col), "path", "licence", "cosine", "origin", "from_dir")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree source / language / hundred of ids."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), path).alias("path")), "doc_id", "path", "text")
