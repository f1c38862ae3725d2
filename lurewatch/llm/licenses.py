"""Licence scan: a trained paragraph classifier, confirmed by templates.  DataFrame and SQL functions only.

A paragraph is a line of a text.  A multinomial logistic regression over sparse
word n-grams (one to three words) learns the licence families and "none" from
the notices below, each with every variant that lacks one word, and the lines that long ones wrap to.  A temperature
chosen on held-out variants calibrates its probabilities; a paragraph that
looks like a licence but fits no family well enough is "unknown".  A predicted
family counts only if enough of one of its notices, and the words that name the
family, stand in the paragraph.  A line that looks like a notice but confirms
none may be a part of a wrapped one: it is judged again together with its
neighbours up to the next line without words (comment marks aren't words), no
further than the longest notice reaches.

Scoring is a projection: no shuffle.  Paragraphs made of neutral words alone
are not scored: the weights themselves bound every sum that such words can
reach, and no family's sum exceeds that of "none".  The corpus has no say in it.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least probability of a family, and least share of a notice's word pairs for confirmation.
CERTAIN, CONFIRM = 0.5, 0.6
BUCKETS = 1024
#: Words of the shortest line that a notice is taken to wrap to; notices of twice as many words teach such lines, too.
WRAPPED = 7
#: Words tried first as neutral ones, since most paragraphs have them (fixed values; they decide the cost, never the result).
PLAIN = "the of and in to a is that it for was an with by this are at he or she be as on not you from can any may which only its were all".split()
#: Notices by family (fixed values).
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "This project is released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This software is available under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "SPDX-License-Identifier: GPL-3.0-or-later",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.",
                "Released under the GPL version 3."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", "SPDX-License-Identifier: GPL-2.0-only",
                "Released under the GPL version 2."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is dedicated to the public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
#: Words that name a family: all of one of its sets must stand in a paragraph for it to be confirmed (fixed values).
NAMES = {
    "apache-2.0": ["apache"],
    "mit": ["mit", "permission hereby granted free charge software"],
    "gpl-3.0": ["gnu 3", "gnu v3", "gpl 3", "gpl v3"],
    "gpl-2.0": ["gnu 2", "gnu v2", "gpl 2", "gpl v2"],
    "lgpl": ["lesser", "lgpl"],
    "agpl-3.0": ["affero", "agpl"],
    "bsd": ["bsd", "redistribution source binary forms conditions"],
    "mpl-2.0": ["mozilla", "mpl"],
    "cc-by-nc": ["by nc", "noncommercial"],
    "cc-by-sa": ["by sa", "sharealike"],
    "cc-by": ["cc by", "commons attribution"],
    "cc0": ["cc0", "waived copyright", "public domain"],
    "proprietary": ["rights reserved", "proprietary"],
}
#: Sentences that use the same words for other things, as examples of "none" (fixed values).
OTHERS = [
    "The driver showed a licence to the officer.", "Renew your driving licence online before it ends.", "The license plate of the car was covered with mud.", "A fishing licence costs ten pounds a year.",
    "The Apache helicopter landed near the camp.", "She studied physics at MIT for five years.", "The gnu is a large antelope of the plains.", "Members of the general public may visit the garden.",
    "Version 2 of the form was sent to the office.", "The museum released a new guide to its rooms.", "Permission to enter the building is needed after eight.", "The creative class of the city works in the old port.",
    "The attribution of the painting is disputed.", "The commons were fenced in that century.", "He was granted a patent in 1904.", "The terms of the treaty were signed in public.",
    "This work is hard and the days are long.", "You may use this door only in an emergency.", "The mozilla was a beast in the story.", "All seats are reserved for the guests.",
]


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(w: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct runs of words."""
    def runs(n: int) -> Column:
        places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    return F.array_distinct(F.concat(*[runs(n) for n in sizes]))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _json(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def examples(spark: SparkSession) -> DataFrame:
    """(family, grams, held) of all notices and other sentences, whole and with each word left out, and of the lines that long notices wrap to."""
    rows = [[f, t] for f, texts in [*NOTICES.items(), ("none", OTHERS)] for t in texts]
    table = spark.range(1).select(F.explode(_json(rows, "array<array<string>>")).alias("x")).select(F.col("x")[0].alias("family"), words(F.col("x")[1]).alias("w"))
    dropped = F.transform(F.sequence(F.lit(0), F.size("w")), lambda i: F.filter("w", lambda _, j: j + 1 != i))
    variants = table.select("family", F.posexplode(dropped).alias("i", "w"))
    held = (F.col("i") > 0) & (F.pmod(F.xxhash64("family", "w"), F.lit(4)) == 0)
    blank = spark.range(1).select(F.lit("none").alias("family"), F.array().cast("array<string>").alias("grams"), F.lit(False).alias("held"))
    lines = F.transform(F.sequence(F.lit(1), F.size("w") - WRAPPED + 1), lambda i: F.slice("w", i, F.lit(WRAPPED)))
    wrapped = table.filter((F.col("family") != "none") & (F.size("w") >= 2 * WRAPPED)).select("family", F.explode(lines).alias("w"))
    return (variants.select("family", ngrams(F.col("w")).alias("grams"), held.alias("held"))
            .unionByName(wrapped.select("family", ngrams(F.col("w")).alias("grams"), F.lit(False).alias("held"))).unionByName(blank))


def fit(spark: SparkSession) -> dict:
    """Weights of the n-grams by family, intercepts and temperature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    families = ["none", *NOTICES]
    table = examples(spark).withColumn("label", (F.array_position(_json(families, "array<string>"), F.col("family")) - 1).cast("double")).coalesce(1)
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0).fit(table)
    learner = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, standardization=False)
    model = learner.fit(vocabulary.transform(table.filter(~F.col("held"))).select("features", "label"))
    rows = model.coefficientMatrix.toArray().T.round(6).tolist()  # as large as the notices, whatever the corpus
    out = {"families": families, "weights": dict(zip(vocabulary.vocabulary, rows)), "intercepts": [round(float(x), 6) for x in model.interceptVector], "temperature": 1.0}
    # the temperature under which held-out variants are likeliest
    logits = _logits(F.col("grams"), out)
    grid = [0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0]
    held = table.filter("held").select("label", logits.alias("z"))
    loss = [F.avg(F.log(F.get(_softmax(F.col("z"), t), F.col("label").cast("int")))).alias(str(i)) for i, t in enumerate(grid)]
    found = held.agg(*loss).first()
    return out | {"temperature": max(zip(found, grid))[1]}


def _logits(grams: Column, model: dict) -> Column:
    """Sum of intercepts and the weights of the n-grams; look-ups go to hash buckets of the literal table."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for gram, row in model["weights"].items():
        buckets[zlib.crc32(gram.encode()) % BUCKETS][gram] = row
    table = _json(buckets, "array<map<string,array<double>>>")
    start = _json(model["intercepts"], "array<double>")
    find = lambda g: F.try_element_at(F.get(table, (F.crc32(g) % BUCKETS).cast("int")), g)
    return F.aggregate(grams, start, lambda z, g: _let(find(g), lambda row: F.when(row.isNull(), z).otherwise(F.zip_with(z, row, lambda a, b: a + b))))


def _softmax(z: Column, temperature: float) -> Column:
    return _let(F.transform(z, lambda x: F.exp((x - F.array_max(z)) / F.lit(temperature))), lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda x: x / s)))


@lru_cache(maxsize=1)
def _notice_words() -> list[str]:
    import re
    return sorted({w for texts in NOTICES.values() for t in texts for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 1})


def marking_words(model: dict) -> list[str]:
    """Words of the model outside a set of neutral ones.

    A set is neutral if, for each family, the intercept and all positive
    weights of the n-grams made of its words sum up to less than what "none"
    gets: any line of such words (and unknown ones) is "none".
    """
    lead = [x - model["intercepts"][0] for x in model["intercepts"][1:]]
    gains = {g: [max(0.0, x - row[0]) for x in row[1:]] for g, row in model["weights"].items()}
    having: dict[str, list[str]] = {}
    for g in gains:
        for w in set(g.split(" ")):
            having.setdefault(w, []).append(g)
    neutral: set[str] = set()
    for word in [*(w for w in PLAIN if w in having), *sorted(having.keys() - set(PLAIN), key=lambda w: (max(gains.get(w, [0.0])), w))]:
        wider = neutral | {word}
        more = [sum(x) for x in zip(lead, *(gains[g] for g in having[word] if wider.issuperset(g.split(" "))))]
        if max(more) < -1e-6:
            neutral, lead = wider, more
    return sorted(having.keys() - neutral)


def scan(docs: DataFrame, model: dict | None = None, marks: list[str] | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, and: n_paragraphs, paragraphs (array of place, family, probability, confirmed), licences.

    ``paragraphs`` lists the lines taken for licence notices, or for a part of
    a wrapped one; an unconfirmed or uncertain one has the family "unknown".
    ``licences`` joins the confirmed families in order, or is null.  Null and
    empty texts have no paragraphs.  Texts of any length are scanned whole.
    Repeated rows are scanned each.  Columns of any name are kept, but for one
    named like a result, which gives way to it.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    model = model or fit(spark)
    marks = marks if marks is not None else marking_words(model)
    results = ["n_paragraphs", "paragraphs", "licences"]
    kept = [c for c in docs.columns if c not in ("text", *results)]
    # by number, so that no name can clash
    packed = F.struct(F.lit(0).alias("none"), *[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("kept")
    marking = _json(marks, "array<string>")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    split = docs.select(packed, F.transform(lines, lambda x, i: F.struct(i.alias("place"), words(x).alias("w"))).alias("lines"))
    families = _json(model["families"], "array<string>")
    pairs = spark.range(1).select(F.explode(_json([[f, t] for f, ts in NOTICES.items() for t in ts], "array<array<string>>")).alias("x")).select(
        F.col("x")[0].alias("f"), ngrams(words(F.col("x")[1]), (2,)).alias("g")).collect()  # the notices above
    templates = {f: [r["g"] for r in pairs if r["f"] == f and r["g"]] for f in NOTICES}
    known = _json(templates, "map<string,array<array<string>>>")
    naming = _json({f: [x.split() for x in ways] for f, ways in NAMES.items()}, "map<string,array<array<string>>>")
    longest = max(len(r["g"]) for r in pairs) + 1

    def judge(x: Column) -> Column:
        def named(p: Column) -> Column:
            best = F.array_max(p)
            family = F.get(families, (F.array_position(p, best) - 1).cast("int"))
            shares = F.transform(F.try_element_at(known, family), lambda t: F.size(F.array_intersect(t, ngrams(x["w"], (2,)))) / F.size(t))
            is_named = F.exists(F.try_element_at(naming, family), lambda way: F.size(F.array_except(way, x["w"])) == 0)
            confirmed = (best >= CERTAIN) & F.coalesce((F.array_max(shares) >= CONFIRM) & is_named, F.lit(False))
            return F.struct(x["place"].cast("long").alias("place"), F.when(family == "none", family).when(confirmed, family).otherwise("unknown").alias("family"),
                            F.round(best, 6).alias("probability"), confirmed.alias("confirmed"))

        return _let(_softmax_let(_logits(ngrams(x["w"]), model), model["temperature"]), named)

    def joined(around: Column, backwards: bool) -> Column:
        """Words of lines one after the other up to a blank one, until they are as many as the longest notice's."""
        def step(s: Column, line: Column) -> Column:
            goes_on = s["open"] & (F.size(line["w"]) > 0) & (F.size(s["w"]) < longest)
            more = F.concat(line["w"], s["w"]) if backwards else F.concat(s["w"], line["w"])
            return F.struct(F.when(goes_on, more).otherwise(s["w"]).alias("w"), goes_on.alias("open"))
        start = F.struct(F.array().cast("array<string>").alias("w"), F.lit(True).alias("open"))
        return F.aggregate(around, start, step, lambda s: s["w"])

    def wrapped(p: Column) -> Column:
        """A line that looks like a notice but confirms none: judged with the lines after it, then with those before it, too."""
        at = p["place"].cast("int") + 1
        own = F.element_at("lines", at)["w"]
        # as every line that counts has a word, no more lines can be needed than words
        after = joined(F.slice("lines", at + 1, F.lit(longest)), False)
        before = joined(F.reverse(F.slice("lines", F.greatest(at - longest, F.lit(1)), F.least(at - 1, F.lit(longest)))), True)
        wider = _let(F.struct(own.alias("own"), after.alias("after")), lambda x: F.array(F.concat(x["own"], x["after"]), F.concat(before, x["own"], x["after"])))
        found = F.transform(wider, lambda w: _let(F.struct(p["place"].alias("place"), w.alias("w")), judge))
        return F.coalesce(F.get(F.filter(found, lambda x: x["confirmed"]), 0), p)

    alone = F.filter(F.transform(F.filter("lines", lambda x: F.arrays_overlap(x["w"], marking)), judge), lambda x: x["family"] != "none")
    judged = split.select("kept", F.size(F.filter("lines", lambda x: F.size(x["w"]) > 0)).cast("long").alias("n_paragraphs"), "lines", alone.alias("alone"))
    out = judged.select("kept", "n_paragraphs", F.transform("alone", lambda p: F.when(p["confirmed"], p).otherwise(wrapped(p))).alias("paragraphs"))
    sure = F.array_sort(F.array_distinct(F.transform(F.filter("paragraphs", lambda x: x["confirmed"]), lambda x: x["family"])))
    return out.select(*[F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(kept)], "n_paragraphs", "paragraphs", F.nullif(F.array_join(sure, ","), F.lit("")).alias("licences"))


def _softmax_let(z: Column, temperature: float) -> Column:
    return _let(z, lambda v: _softmax(v, temperature))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
