"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

A paragraph (line) is described by its word unigrams and bigrams. A sparse multinomial logistic regression (L1) tells
licence families, other licence statements ("unknown") and ordinary text ("none") apart. It is fitted on a bounded set: statements built from the
templates below with words left out and ordinary words around them, statements that name no known family, and the lines of SAMPLE_DOCS
documents (the least id hashes) without licence vocabulary. A fifth of that set stays out and calibrates the lowest probability at which
a line counts as a licence statement and the lowest at which a family is named. A named family must be confirmed: CONFIRM of the n-grams of
one of its templates stand in the line. Otherwise the answer is "unknown".

Scanning uses DataFrame functions only. A line needs one of the n-grams that speak for a licence class most (the rest together
can't beat "none"); lines without one are left before n-grams are built, by their words. All lines of all documents are read.

Defined cases: null and empty texts have no lines with words and give no row; a null id is reported as null; repeated
rows give repeated rows; without documents to sample, statements alone train the model; other columns are ignored.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tubelens.llm.common import documents, stored

SAMPLE_DOCS = 1500
VOCABULARY = 4000
CONFIRM = 0.6
PRECISION = 0.99
NONE, UNKNOWN = "none", "unknown"

# Names and notices of public licences.
NAMES = {
    "apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache 2.0 License"],
    "mit": ["the MIT License", "the MIT licence", "the terms of the MIT License", "MIT License"],
    "gpl-2.0": ["the GNU General Public License, version 2", "GPL-2.0", "the GNU GPL v2", "GPLv2"],
    "gpl-3.0": ["the GNU General Public License, version 3", "GPL-3.0", "the GNU GPL v3", "GPLv3"],
    "lgpl-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0", "the GNU LGPL v3"],
    "agpl-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0", "the GNU AGPL v3"],
    "bsd-3-clause": ["the BSD 3-Clause License", "BSD-3-Clause", "the New BSD License", "a BSD-style license"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0", "the MPL 2.0"],
    "cc-by-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "isc": ["the ISC License", "ISC License"],
    "epl-2.0": ["the Eclipse Public License, version 2.0", "EPL-2.0"],
}
NOTICES = {
    "apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
}
OTHER_NAMES = ["the Example Source License 1.1", "our own terms of use", "a custom license", "the terms in the file LICENSE", "the Foobar Public License",
               "a proprietary license", "the license of the vendor", "the Acme Community License, version 5", "special written permission"]
FRAMES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is available under {}.",
          "License: {}", "Published under {}; see the LICENSE file."]
# End of fixed values.
VOCABULARY_WORDS = "licen|copyright|redistribut|permission|warrant|gnu|apache|mozilla|creative commons"


def trimmed(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits, dots and hyphens, without dots and hyphens at their ends."""
    return F.filter(F.transform(F.split(F.lower(text), "[^a-z0-9.\\-]+"), lambda w: F.btrim(w, F.lit(".-"))), lambda w: F.length(w) > 0)


def grams(w: Column) -> Column:
    """Unigrams and bigrams, each once."""
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))),
                                             lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, pairs))


def statements(spark) -> DataFrame:
    """``label, text``: the template statements."""
    rows = [(k, f.format(n)) for k, names in NAMES.items() for n in names for f in FRAMES]
    rows += [(k, n) for k, notices in NOTICES.items() for n in notices]
    rows += [(UNKNOWN, f.format(n)) for n in OTHER_NAMES for f in FRAMES]
    return spark.createDataFrame(rows, "label string, text string")


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, para, line`` of every text; ``para`` counts from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "line"))


def training_set(docs: DataFrame) -> DataFrame:
    """``label, words``: bounded by the templates and SAMPLE_DOCS documents."""
    spark = docs.sparkSession
    base = statements(spark).select("label", trimmed(F.col("text")).alias("w"))
    # every word left out once
    cut = base.select("label", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i")).where("size(w) > 3")
    cut = cut.select("label", F.expr("filter(w, (x, k) -> k <> i)").alias("w"))
    picked = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    plain = lines(docs.join(F.broadcast(picked), "doc_id")).where(~F.lower("line").rlike(VOCABULARY_WORDS))
    plain = stored(plain.select(F.lit(NONE).alias("label"), trimmed(F.col("line")).alias("w")).where("size(w) > 0"), "plain")
    # ordinary words around a statement: the n-th statement takes the n-th line
    some = plain.select("w").orderBy(F.xxhash64("w")).limit(400).select(F.slice("w", 1, 6).alias("x"), (F.pmod(F.xxhash64("w"), F.lit(40))).alias("j"))
    around = base.withColumn("j", F.pmod(F.xxhash64("w"), F.lit(40))).join(F.broadcast(some), "j").where(F.pmod(F.xxhash64("w", "x"), F.lit(4)) == 0)
    around = around.select("label", F.concat("x", "w", F.reverse("x")).alias("w"))
    return base.unionByName(cut).unionByName(around).unionByName(plain)


def train(docs: DataFrame) -> dict:
    """n-gram weights per class (classes x n-grams), intercepts and the calibrated threshold."""
    rows = stored(training_set(docs).select("label", grams(F.col("w")).alias("g")).repartition(4), "training")
    held = F.pmod(F.xxhash64("g"), F.lit(5)) == 0
    vec = CountVectorizer(inputCol="g", outputCol="x", binary=True, minDF=2, vocabSize=VOCABULARY).fit(rows.where(~held))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    data = index.transform(vec.transform(rows))
    lr = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", elasticNetParam=1.0, regParam=5e-4, maxIter=40, standardization=False)
    model = lr.fit(data.where(~held))
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    labels = list(index.labels)
    seen = model.transform(data.where(held)).select("label", vector_to_array("probability").alias("p")).collect()  # a fifth of a bounded set
    tau = thresholds([r["label"] for r in seen], np.array([r["p"] for r in seen]).reshape(len(seen), len(labels)), labels)
    used = np.flatnonzero(np.abs(weights).max(0) > 1e-6)
    return {"labels": labels, "bias": bias, "vocab": [vec.vocabulary[i] for i in used], "weights": weights[:, used], "thresholds": tau}


def thresholds(truth: list[str], p: np.ndarray, labels: list[str]) -> tuple[float, float]:
    """Least probability of a licence statement, and of a named family, that is right in PRECISION of the held cases."""
    if not len(truth):
        return 0.5, 0.5
    grid = np.arange(0.30, 0.96, 0.05)
    least = lambda p, right: next((float(round(t, 2)) for t in grid if (p >= t).any() and right[p >= t].mean() >= PRECISION), 0.95)
    none = np.array([t == NONE for t in truth])
    some = 1 - p[:, labels.index(NONE)] if NONE in labels else np.ones(len(truth))
    best = p.argmax(1)
    named = np.array([labels[b] not in (NONE, UNKNOWN) for b in best])
    right = np.array([labels[b] == t for b, t in zip(best, truth)])
    return max(0.9, least(some, ~none)), least(np.where(named, p.max(1), 0), right)


def speaking(model: dict) -> list[str]:
    """n-grams without any of which no line reaches the least probability, even with all the others in it."""
    labels = model["labels"]
    if NONE not in labels:
        return list(model["vocab"])
    none, least = labels.index(NONE), model["thresholds"][0]
    out: set[int] = set()
    for c in range(len(labels)):
        if c == none:
            continue
        gain = np.maximum(model["weights"][c] - model["weights"][none], 0)
        # some class must come this close to "none"
        margin = model["bias"][none] - model["bias"][c] + np.log(least / (1 - least) / (len(labels) - 1))
        order = np.argsort(gain, kind="stable")
        weak = int(np.searchsorted(np.cumsum(gain[order]), margin - 1e-3))  # all of these together stay below
        out |= set(order[weak:].tolist())
    return [model["vocab"][i] for i in sorted(out)]


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, para, family, likeliest, score, coverage, confirmed`` of every line that holds a licence statement."""
    labels, vocab = model["labels"], model["vocab"]
    speaks = speaking(model)
    # a bigram needs both its words: one of them stands for it, preferably one that speaks itself
    own = {v for v in speaks if " " not in v}
    triggers = own | {max(v.split(" "), key=len) for v in speaks if " " in v and not own & set(v.split(" "))}
    weight = {v: [round(float(x), 6) for x in model["weights"][:, i]] for i, v in enumerate(vocab)}
    array = lambda xs: F.array(*[F.lit(x) for x in xs])  # noqa: E731  folded into a literal
    templates = {k: sorted({tuple(_grams(t)) for t in [f.format(n) for n in names for f in FRAMES] + NOTICES.get(k, [])})
                 for k, names in NAMES.items()}
    shapes = F.map_from_arrays(array(list(templates)), F.array(*[F.array(*[array(t) for t in ts]) for ts in templates.values()]))
    # a generator keeps each step from being copied into the filters above it
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))
    rows = once(lines(docs.select("doc_id", "text")), "w", trimmed(F.col("line"))).select("doc_id", "para", "w")
    rows = rows.where(F.arrays_overlap("w", array(sorted(triggers))))
    rows = once(once(rows, "g", grams(F.col("w"))), "hit", F.array_intersect("g", array(vocab)))
    rows = rows.where(F.arrays_overlap("hit", array(speaks)))
    zero = array([round(float(x), 6) for x in model["bias"]])
    table = F.map_from_arrays(array(list(weight)), F.array(*[array(x) for x in weight.values()]))
    rows = once(rows, "z", F.aggregate("hit", zero, lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b)))
    rows = once(rows, "m", F.array_max("z"))
    rows = once(rows, "p", F.transform("z", lambda v: F.exp(v - F.col("m"))))
    rows = once(rows, "total", F.aggregate("p", F.lit(0.0), lambda acc, v: acc + v))
    some, named = model["thresholds"]
    if NONE in labels:
        rows = rows.where(1 - F.element_at("p", labels.index(NONE) + 1) / F.col("total") >= some)
    rows = rows.withColumn("score", 1 / F.col("total"))
    rows = rows.withColumn("best", F.element_at(array(labels), F.array_position("z", F.col("m")).cast("int")))
    cover = F.array_max(F.transform(F.element_at(shapes, F.col("best")),
                                    lambda t: F.size(F.array_intersect(t, F.col("g"))) / F.size(t)))
    rows = rows.withColumn("coverage", F.coalesce(cover, F.lit(0.0)))
    confirmed = (F.col("score") >= named) & (F.col("coverage") >= CONFIRM)
    return rows.select("doc_id", F.col("para").cast("long").alias("para"), F.when(confirmed, F.col("best")).otherwise(F.lit(UNKNOWN)).alias("family"),
                       F.col("best").alias("likeliest"), "score", "coverage", confirmed.alias("confirmed"))


def _grams(text: str) -> list[str]:
    """The n-grams of a template, as ``grams(trimmed(...))`` gives them."""
    w = [x.strip(".-") for x in re.split(r"[^a-z0-9.\-]+", text.lower())]
    w = [x for x in w if x]
    return list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))


def op3_license_scan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return scan(docs, train(docs))
