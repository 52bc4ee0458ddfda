"""License scans: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance by directory.

DataFrame functions only. The templates are a fixed table, so their term weights are literals of the plan; the vector of a
line, or of a few lines for a wrapped sentence, is built in its row, without explode or shuffle, and a path join finds the
nearest ancestor directory with a licence.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Headers, titles and opening sentences by SPDX identifier. Several texts may stand for one licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Proprietary", "All rights reserved. Proprietary and confidential"),
)
TERM = r"[^a-z0-9.]+"
#: A line has to hold one of these to be compared, alone and with the lines around it.
ANCHOR = r"(?i)licen|copyright|rights|redistribut|permission|domain"
#: Columns that scan() makes; those of such names in its input give way.
_MADE = ("own_license", "cosine", "line", "is_license_file", "license", "inherited_from")


def terms_of(text: str) -> list[str]:
    return [t for t in (x.strip(".") for x in re.split(TERM, text.lower())) if t]


def _terms(c):
    return F.filter(F.transform(F.split(F.lower(c), TERM), lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")), lambda t: t != "")


class Model:
    """Unit TF-IDF vectors of the templates over their own terms; a term in no template has the highest idf."""

    def __init__(self, templates=TEMPLATES):
        bags = [(name, Counter(terms_of(text))) for name, text in templates]
        n, df = len(bags), Counter(t for _, bag in bags for t in bag)
        self.idf = {t: 1 + math.log((1 + n) / (1 + k)) for t, k in df.items()}
        self.unseen = 1 + math.log(1 + n)
        self.rows = []
        for name, bag in bags:
            norm = math.sqrt(sum((c * self.idf[t]) ** 2 for t, c in bag.items()))
            self.rows.append((name, {t: c * self.idf[t] / norm for t, c in bag.items()}))


def _literal(d: dict[str, float]):
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))])


def _dot(vector, weights):
    return F.aggregate(vector, F.lit(0.0), lambda a, y: a + y["w"] * F.coalesce(F.element_at(weights, y["t"]), F.lit(0.0)))


def candidates(text, span: int = 3):
    """(i, line) of each line with an anchor, alone and in the runs of ``span`` lines that it is in, which begin at line i; null
    for a text without any."""

    def of(lines):
        hits = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: x["line"].rlike(ANCHOR))

        def run(h, back):
            first = F.greatest(h["i"] - back, F.lit(0))
            return F.struct(first.alias("i"), F.array_join(F.slice(lines, first + 1, F.lit(span)), " ").alias("line"))

        return F.flatten(F.transform(hits, lambda h: F.array(h, *[run(h, k) for k in range(span)])))

    return F.when(text.rlike(ANCHOR), F.element_at(F.transform(F.array(F.split(text, r"\r?\n")), of), 1))


def nearest_template(lines, model: Model):
    """Of an array of (i, line): the best (cosine, neg_i, neg_o, license), so the first line and template of equals, and rival, the
    best cosine of the same lines to another licence's template.

    Null for no lines. Each step reads the one before once: higher-order functions have no common subexpressions.
    """
    idf = _literal(model.idf)
    termed = F.transform(lines, lambda x: F.struct(x["i"].alias("i"), _terms(x["line"]).alias("terms")))
    weigh = lambda x, t: F.size(F.filter(x["terms"], lambda y: y == t)) * F.coalesce(F.element_at(idf, t), F.lit(model.unseen))
    vectors = F.transform(termed, lambda x: F.struct(x["i"].alias("i"), F.transform(F.array_distinct(x["terms"]), lambda t: F.struct(t.alias("t"), weigh(x, t).alias("w"))).alias("v")))
    normed = F.transform(vectors, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"), F.sqrt(F.aggregate(x["v"], F.lit(0.0), lambda a, y: a + y["w"] * y["w"])).alias("n")))

    def scored(x):
        out = []
        for o, (name, weights) in enumerate(model.rows):
            dot = _dot(x["v"], _literal(weights))
            out.append(F.struct(F.round(dot / F.greatest(x["n"], F.lit(1e-9)), 9).alias("cosine"), (-x["i"]).alias("neg_i"), F.lit(-o).alias("neg_o"), F.lit(name).alias("license")))
        # Bound to a name, as the array is used several times.
        best = F.transform(F.array(F.array(*out)), lambda a: F.struct(F.array_max(a).alias("b"), a.alias("a")))
        other = lambda v: F.array_max(F.transform(F.filter(v["a"], lambda o: o["license"] != v["b"]["license"]), lambda o: o["cosine"]))
        return F.element_at(F.transform(best, lambda v: F.struct(*[v["b"][c].alias(c) for c in ("cosine", "neg_i", "neg_o", "license")], F.coalesce(other(v), F.lit(0.0)).alias("rival"))), 1)

    return F.array_max(F.transform(normed, scored))


def directory(path):
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", least: float = 0.6, file_words: int = 60, templates=TEMPLATES, margin: float = 0.02) -> DataFrame:
    """Each row of ``files`` (path, text) without its text, and: own_license, cosine, line, is_license_file, license, inherited_from.

    A line is a candidate if it holds an anchor (licen, copyright, rights, redistribut, permission, domain), alone and with its
    neighbours in runs of three lines; the TF-IDF cosine to each template decides, ``least`` or more. own_license is the best
    candidate's (the first line and template of equals), or none if another licence comes within ``margin`` of it there. A licence file is named LICENSE, LICENCE or COPYING, or has at most
    ``file_words`` words and an own licence. license is own_license, else that of the nearest ancestor directory with a
    licence file (in one directory: the highest cosine, then the smallest path); inherited_from is that directory.
    Columns of these names give way.
    Null and empty texts have no own licence; null paths count as the top directory; repeated rows each get a row, an empty
    table none. Texts of any length are compared whole; each is read once, as what is found is written before it is joined.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = files.select(
        F.struct(*[c for c in files.columns if c != text and (c == path or c not in _MADE)]).alias("_row"),
        F.coalesce(F.col(path), F.lit("")).alias("_path"),
        nearest_template(candidates(whole), Model(templates)).alias("_best"),
        F.size(F.filter(F.split(whole, r"\s+"), lambda w: w != "")).alias("_words"),
    )
    sure = (F.col("_best.cosine") >= least) & (F.col("_best.cosine") - F.col("_best.rival") >= margin)
    own = own.select("_row", "_path", directory(F.col("_path")).alias("_dir"), "_words", *[F.when(sure, F.col(f"_best.{c}")).alias(to) for c, to in (("license", "own_license"), ("cosine", "cosine"), ("neg_i", "_neg"))])
    named = F.col("_path").rlike(r"(?i)(^|/)(licen[sc]e|copying)(\.[a-z]+)?$")
    own = written(own.withColumn("is_license_file", F.col("own_license").isNotNull() & (named | (F.col("_words") <= file_words))), "licenses")
    # One row a directory with a licence file, whatever the number of its files.
    by_dir = own.where("is_license_file").groupBy(F.col("_dir").alias("_at")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "_path", "own_license")).alias("_b"))
    # Each directory that holds files, with its ancestors.
    parts = F.split("_dir", "/")
    dirs = own.select("_dir").distinct().withColumn("_up", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))))
    nearest = dirs.join(by_dir, F.col("_up") == F.col("_at")).groupBy("_dir").agg(F.max_by(F.struct("_up", "_b.own_license"), F.length("_up")).alias("_n"))
    out = own.join(nearest, "_dir", "left")
    return out.select("_row.*", "own_license", "cosine", (-F.col("_neg")).alias("line"), "is_license_file", F.coalesce("own_license", F.col("_n.own_license")).alias("license"), F.when(F.col("own_license").isNull(), F.col("_n._up")).alias("inherited_from"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Files are the documents, each at source/lang/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(files)


QUERIES = {"op8_licenses": op8_licenses}
SQL: dict[str, str] = {}
