"""Licence scans: a paragraph classifier over sparse word n-grams, in Spark expressions.

Templates of licence notices, notices of families without a template (the
unknown class), variants of both with words left out, and ordinary paragraphs
train a multinomial logistic regression on the word pairs and triples that the
notices hold, and on the words of licences in general.  Its weights are a small
table; scoring is a join of the paragraphs' n-grams with it and a sum.  The
least probability for a known family is calibrated on a model that has not seen
a third of the variants, nor any notice of a third of the unknown families.  A
prediction counts as confirmed only if the paragraph also shares enough n-grams
with a template of that family; other licence paragraphs are unknown.

Only texts that hold one of ``WORDS`` are cut into n-grams: every notice has one.

A notice may stand on one line or be wrapped over several.  n-grams therefore
also run over line ends, and beside each single line the stretches of
neighbouring lines that together hold enough of one template are scored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, table

# Families and the wording of their usual notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "This software is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1 or later."),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain under CC0 1.0 Universal."),
    ("reserved", "All rights reserved."),
    ("reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."),
)
# Usual notices of families that have no template; they train the unknown class.
OTHERS = (
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software."),
    ("eclipse", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("artistic", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License."),
    ("eupl", "Licensed under the EUPL, Version 1.2 or later. You may not use this work except in compliance with the Licence."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted."),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("psf", "Licensed to the Python Software Foundation under a Contributor Agreement."),
    ("wtfpl", "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2."),
    ("ms-pl", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
)
# Sentences that use the words of licences and are none.
PROSE = (
    "His driving license had expired the week before.", "She asked for permission to leave early.", "The restaurant lost its license to sell wine.", "Copyright was the subject of the lecture.",
    "The new car came with a warranty of three years.", "Nobody had permission to enter the room.", "The film fell into the public domain long ago.", "The court will redistribute the land among the heirs.",
    "A fishing licence costs twelve pounds a year.", "The warranty does not cover the battery.", "He wrote a book on copyright and its history.", "Dogs are not permitted in the garden.",
)
#: Texts that hold one of these lend no ordinary lines to the training.
WORDS = ("licens", "licenc", "copyright", "permission", "permitted", "redistribut", "warrant", "public domain", "rights reserved", "cc by", "cc0")
#: Words that speak of licences in general.
GENERAL = ("license", "licence", "licensed", "copyright", "permission", "permitted", "redistribute", "redistribution", "warranty", "warranties", "liable", "distribute", "distributed", "hereby", "granted")
NONE, UNKNOWN = "none", "unknown"
FAMILIES = sorted({f for f, _ in TEMPLATES})
#: Ordinary paragraphs of the corpus that training may see at most.
PLAIN_ROWS = 2_000
#: Share of a paragraph's known n-grams that its template must hold, and of the template's that it must hold.
CONFIRM = 0.5
_WORD = r"[^\p{L}\p{N}]+"


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, place, paragraph)``: the lines of every whole text that hold a letter, or digit."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "paragraph"))
    return lines.where(F.col("paragraph").rlike(r"[\p{L}\p{N}]"))


def _general(words: str) -> Column:
    return F.filter(words, lambda w: w.isin(*GENERAL))


def _n_grams(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``gram``: pairs, triples and general words by neighbouring rows of one split, without nested copies."""
    cut = rows.withColumn("w_", F.concat(F.array(F.lit("^")), F.split(F.lower(F.regexp_replace("paragraph", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), _WORD), F.array(F.lit("$"))))
    size = F.size("w_")
    gram = F.concat(
        F.zip_with(F.slice("w_", F.lit(1), size - 1), F.slice("w_", F.lit(2), size - 1), lambda a, b: F.concat_ws(" ", a, b)),
        F.zip_with(F.zip_with(F.slice("w_", F.lit(1), size - 2), F.slice("w_", F.lit(2), size - 2), lambda a, b: F.concat_ws(" ", a, b)), F.slice("w_", F.lit(3), size - 2), lambda a, b: F.concat_ws(" ", a, b)),
        _general("w_"),
    )
    return cut.select(*keys, F.explode_outer(gram).alias("gram")).where("gram is not null")


def _line_grams(docs: DataFrame, words: list[str]) -> DataFrame:
    """``(doc_id, text_key, place, own, gram)``: n-grams of each line, and (not ``own``) those that run into it over line ends.

    The latter start in the line before, or, where that has one word, in the two before; a blank line ends them.
    Of n-grams within a line only those are made whose every word is in ``words``,
    which holds all words of the n-grams asked for (and ``^`` and ``$``): words
    outside it cut a line into stretches, and stretches of one word hold no n-gram.
    """
    from pyspark.ml.feature import NGram

    lines = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " "), "\n")
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), lines.alias("line"))
    none = F.array(F.lit(""))
    rows = rows.select("doc_id", "text_key", F.posexplode(F.arrays_zip("line", F.concat(none, "line").alias("p1"), F.concat(none, none, "line").alias("p2"))).alias("place", "x"))
    rows = rows.select("doc_id", "text_key", "place", *(F.trim(f"x.{c}").alias(c) for c in ("line", "p1", "p2"))).where("line <> ''")
    tail = F.split(F.substring_index("p1", " ", -2), " ")
    before = F.when(F.size(tail) == 2, tail).when(F.col("p1") != "", F.array(F.when(F.col("p2") == "", "^").otherwise(F.substring_index("p2", " ", -1)), F.col("p1")))
    rows = rows.select("doc_id", "text_key", "place", F.split(F.concat(F.lit("^ "), "line", F.lit(" $")), " ").alias("w_"), before.alias("b"))
    w, b = F.col("w_"), F.col("b")
    known = F.transform(w, lambda x: F.when(x.isin(*words), x).otherwise(""))
    stretches = F.filter(F.split(F.concat_ws(" ", known), "  +"), lambda x: F.contains(F.trim(x), F.lit(" ")))
    pair = lambda x, y: F.concat_ws(" ", x, y)
    over = F.when(b.isNotNull(), F.array(pair(b[1], w[1]), F.concat_ws(" ", b[0], b[1], w[1]), F.concat_ws(" ", b[1], w[1], w[2]))).otherwise(F.array().cast("array<string>"))
    general = F.array_intersect("w_", F.array(*(F.lit(x) for x in GENERAL)))
    tagged = lambda tag, pieces: F.transform(pieces, lambda x: F.concat(F.lit(tag), x))
    rows = rows.select("doc_id", "text_key", "place", F.explode(F.concat(tagged("=", stretches), tagged("=", general), tagged("+", over))).alias("piece"))
    rows = rows.select("doc_id", "text_key", "place", F.startswith("piece", F.lit("=")).alias("own"), F.trim(F.substring("piece", 2, 1 << 30)).alias("piece"))
    rows = rows.withColumn("v_", F.split("piece", " "))
    rows = NGram(n=3, inputCol="v_", outputCol="triples").transform(NGram(n=2, inputCol="v_", outputCol="pairs").transform(rows))
    grams = F.when(F.col("own") & F.contains("piece", F.lit(" ")), F.concat("pairs", "triples")).otherwise(F.array("piece"))
    return rows.select("doc_id", "text_key", "place", "own", F.explode(grams).alias("gram"))


def _sample(lines: DataFrame, most: int) -> DataFrame:
    """The ``most`` distinct lines with the smallest hashes.

    Lines are first counted by the length of their hash in bits (64 counts), so
    that about ``2 * most`` to ``4 * most`` of them are sorted at any size of
    the input, not ``most`` from each task.
    """
    hashed = lines.withColumn("h", F.xxhash64("doc_id", "place")).withColumn("bits", F.length(F.bin(F.col("h").bitwiseXOR(F.lit(-(2**63))))))
    seen, bits = 0, 64
    for r in hashed.groupBy("bits").agg(F.approx_count_distinct("h").alias("n")).orderBy("bits").collect():
        seen += r["n"]
        if seen >= 2 * most:
            bits = r["bits"]
            break
    return hashed.where(F.col("bits") <= bits).drop("bits").distinct().orderBy("h", "doc_id", "place", "paragraph").limit(most).drop("h")


def speaks_of_licences() -> Column:
    low = F.lower("text")
    found = F.contains(low, F.lit(WORDS[0]))
    for w in WORDS[1:]:
        found = found | F.contains(low, F.lit(w))
    return found


def _like_a_notice(lines: DataFrame) -> DataFrame:
    """Of ``lines`` (``h``, ``paragraph``) those whose n-grams a notice holds by half, or that hold half of a notice's: they train as no class."""
    notices = lines.sparkSession.createDataFrame([(i, t) for i, (_, t) in enumerate((*TEMPLATES, *OTHERS))], "t int, paragraph string")
    of = _n_grams(notices, "t").distinct()
    of = of.join(of.groupBy("t").agg(F.count("*").alias("size")), "t")
    own = _n_grams(lines, "h").distinct()
    sizes = own.groupBy("h").agg(F.count("*").alias("n_own"))
    shared = own.join(F.broadcast(of), "gram").groupBy("h", "t", "size").agg(F.count("*").alias("n")).join(sizes, "h")
    return shared.where((F.col("n") >= CONFIRM * F.col("size")) | (F.col("n") >= CONFIRM * F.col("n_own"))).select("h").distinct()


def _gist(notice: str) -> str:
    """The general words of a notice, apart from each other, if there are three: what a notice of an unseen family has in common with it."""
    words = [w for w in dict.fromkeys(re.split(r"[\W_]+", notice.lower())) if w in GENERAL]
    return " x ".join(words) if len(words) >= 3 else ""


def training(docs: DataFrame) -> DataFrame:
    """``(row, family, paragraph, held_out)``: notices with a template and without one, their general words alone, variants of these with each fifth and each single word left out, and plain paragraphs.

    A quarter of the variants of templates are held out, and all notices of a third of the unknown families.
    """
    spark = docs.sparkSession
    unknown = sorted({f for f, _ in OTHERS})
    notices = [(f, t, False) for f, t in TEMPLATES] + [(UNKNOWN, t, unknown.index(f) % 3 == 0) for f, t in OTHERS] + [(NONE, t, False) for t in PROSE]
    notices += [(UNKNOWN, t, False) for t in sorted({_gist(t) for _, t in (*TEMPLATES, *OTHERS)} - {""})]
    rows = spark.createDataFrame([(*n, i) for i, n in enumerate(notices)], "family string, paragraph string, apart boolean, t int")
    words = rows.select("family", "t", "apart", F.split("paragraph", " ").alias("w")).withColumn("cut", F.explode(F.sequence(F.lit(-1), F.size("w") + 2)))
    by_one = F.filter("w", lambda x, i: i != F.col("cut"))
    by_third = F.filter("w", lambda x, i: (i + F.col("cut")) % 5 != 0)
    variants = words.select("family", "apart", F.explode(F.array(F.concat_ws(" ", by_one), F.concat_ws(" ", by_third))).alias("paragraph")).distinct()
    # ordinary lines of texts with small hashes; how many texts there are tells how small
    known = docs.where("doc_id is not null")
    share = min(1.0, 8 * PLAIN_ROWS / max(known.count(), 1))
    some = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30))) & ~speaks_of_licences())
    plain = materialize(_sample(paragraphs(some), PLAIN_ROWS).select(F.xxhash64("paragraph").alias("h"), "paragraph").distinct(), "plain-lines")
    plain = plain.join(_like_a_notice(plain), "h", "left_anti").select(F.lit(NONE).alias("family"), F.lit(False).alias("apart"), "paragraph")
    both = variants.unionByName(plain).withColumn("row", F.xxhash64("family", "paragraph"))
    return both.select("row", "family", "paragraph", (F.col("apart") | (F.col("family") != UNKNOWN) & (F.pmod("row", F.lit(4)) == 0)).alias("held_out"))


CLASSES = [*FAMILIES, UNKNOWN, NONE]
#: Stands for an absent id in joins.
NO_ID = -(2**63)


def _model(vectors: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, list[float]]:
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(maxIter=60, regParam=0.002, family="multinomial").fit(vectors)
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = [(g, [float(matrix[c][i]) for c in range(len(matrix))]) for i, g in enumerate(vocabulary)]
    return vectors.sparkSession.createDataFrame(weights, "gram string, weights array<double>"), [float(x) for x in intercepts]


def fit(docs: DataFrame) -> tuple[DataFrame, dict[str, float], float]:
    """Weights ``(gram, weights by class)``, intercepts, and the calibrated least probability of a known family."""
    from pyspark.ml.feature import CountVectorizer

    spark = docs.sparkSession
    rows = materialize(training(docs), "licence-training")
    notices = spark.createDataFrame([(t,) for _, t in (*TEMPLATES, *OTHERS)], "paragraph string")
    known = _n_grams(rows, "row").join(F.broadcast(_n_grams(notices).distinct()), "gram").groupBy("row").agg(F.array_sort(F.collect_set("gram")).alias("grams"))
    number = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col("family")) - 1
    data = rows.join(known, "row", "left").withColumn("grams", F.coalesce("grams", F.array().cast("array<string>"))).withColumn("label", number.cast("double"))
    data = materialize(data, "licence-features")
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(data)
    vectors = vectorizer.transform(data)
    weights, intercepts = _model(vectors.where("not held_out"), vectorizer.vocabulary)
    scored = _predict(data.where("held_out").select("row", "family", "grams"), weights, intercepts, ["row", "family"])
    # the least probability at which held-out rows that are given a known family are right 99 times in 100; at most some thousand rows
    tested = scored.select("p", (F.col("best") == F.col("family")).cast("int").alias("right")).where(~F.col("best").isin(NONE, UNKNOWN)).orderBy(F.desc("p")).collect()
    least, right = 0.5, 0
    for n, r in enumerate(tested, 1):
        right += r["right"]
        if right / n < 0.99:
            least = max(least, min(0.99, r["p"] + 1e-6))
            break
    # what was held out is learned in the end, too
    weights, intercepts = _model(vectors, vectorizer.vocabulary)
    return weights, dict(zip(CLASSES, intercepts, strict=True)), least


def _softmax(scores: Column, classes: list[str]) -> list[Column]:
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    best = F.array_position(scores, top).cast("int")
    return [F.element_at(F.array(*(F.lit(c) for c in classes)), best).alias("best"), (F.lit(1.0) / total).alias("p")]


def _predict(rows: DataFrame, weights: DataFrame, intercepts: list[float], keys: list[str]) -> DataFrame:
    hit = rows.select(*keys, F.explode_outer("grams").alias("gram")).join(F.broadcast(weights), "gram", "left")
    return _scored(hit, intercepts, CLASSES, keys)


def _scored(hit: DataFrame, intercepts: list[float], classes: list[str], keys: list[str], *more: Column) -> DataFrame:
    sums = [F.coalesce(F.sum(F.element_at("weights", i + 1)), F.lit(0.0)).alias(f"s{i}") for i in range(len(classes))]
    total = hit.groupBy(*keys).agg(*sums, *more)
    scores = F.array(*(F.col(f"s{i}") + F.lit(float(intercepts[i])) for i in range(len(classes))))
    rest = [c for c in total.columns if not c.startswith("s") or not c[1:].isdigit()]
    return total.select(*rest, scores.alias("scores")).select(*rest, *_softmax(F.col("scores"), classes))


def _stretches(hit: DataFrame, shared: DataFrame, template: DataFrame) -> DataFrame:
    """``(doc_id, text_key, t, family, first, last, share)``: neighbouring lines that together hold ``CONFIRM`` of template ``t``.

    A stretch has at most as many lines as the template has words.  Lines that
    hold a single n-gram of the template do not count; of the stretches that
    start in turn those with the most n-grams remain.  ``shared`` counts the
    n-grams by line and template, and leaves few documents before any stretch is built.
    """
    doc = ["doc_id", "text_key"]
    lines = shared.where("n > 1")
    enough = lines.groupBy(*doc, "t", "size").agg(F.sum("n").alias("n"), F.count("*").alias("lines")).where((F.col("lines") > 1) & (F.col("n") >= CONFIRM * F.col("size"))).select(*doc, "t")
    lines = materialize(lines.join(enough, [*doc, "t"], "left_semi").select(*doc, "t", "family", "size", "place"), "licence-lines")
    words = template.select("t", "gram", "words")
    grams = hit.join(lines, [*doc, "place"]).join(F.broadcast(words), ["t", "gram"])
    # each line belongs to the stretches that start at it or up to ``words - 1`` lines before it
    grams = grams.withColumn("start", F.explode(F.sequence(F.greatest(F.col("place") - F.col("words") + 1, F.lit(0)), F.col("place")))).where("own or start < place")
    of = [*doc, "t", "family", "size", "start"]
    found = grams.groupBy(*of, "gram").agg(F.min("place").alias("place")).groupBy(*of).agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
    order = Window.partitionBy(*doc, "t").orderBy("start")
    near = lambda f: F.coalesce(f("n").over(order), F.lit(0))
    found = found.withColumn("most", F.greatest("n", near(F.lag), near(F.lead))).where((F.col("n") == F.col("most")) & (F.col("n") >= CONFIRM * F.col("size")) & (F.col("first") < F.col("last")))
    return found.groupBy(*doc, "t", "family", "first", "last").agg((F.max("n") / F.max("size")).alias("share"))


def _wrapped(hit: DataFrame, stretches: DataFrame, weights: DataFrame, intercepts: list[float], classes: list[str], least: float) -> DataFrame:
    """``(doc_id, text_key, family, first, last, p)``: stretches that the classifier gives to their template's family; overlapping ones of a family are one."""
    keys = ["doc_id", "text_key", "t", "family", "first", "last"]
    lines = stretches.select(*keys, F.explode(F.sequence("first", "last")).alias("place"))
    grams = hit.join(lines, ["doc_id", "text_key", "place"]).where("own or place > first").select(*keys, "gram").distinct()
    scored = _scored(grams.join(F.broadcast(weights), "gram"), intercepts, classes, keys).where((F.col("best") == F.col("family")) & (F.col("p") >= least))
    order = Window.partitionBy("doc_id", "text_key", "family").orderBy("first", "last")
    seen = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    scored = scored.withColumn("new", F.when(F.col("first") <= seen, 0).otherwise(1))
    scored = scored.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return scored.groupBy("doc_id", "text_key", "family", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("p").alias("p")).drop("part")


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, place, family, p, confirmed)`` for each paragraph that reads like a licence notice.

    A paragraph is a line, or the neighbouring lines of a wrapped notice
    (``place`` is the first).  ``family`` is ``unknown`` where the classifier says
    so, where the probability is below the calibrated one, or where no template
    of the family confirms it; neighbouring unknown lines are one paragraph.  Null
    and empty texts have no paragraphs; rows that repeat an id and a text count
    once.  Of classes with equal scores the first in ``CLASSES`` counts.
    """
    spark = docs.sparkSession
    # rows without an id are told apart by their texts
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    weights, intercepts, least = fit(docs)
    classes = list(intercepts)
    template = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "t int, family string, paragraph string")
    template = template.withColumn("words", F.size(F.split("paragraph", _WORD)))
    held = materialize(_n_grams(template, "t", "family", "words").distinct(), "templates")
    sizes = held.groupBy("t").agg(F.count("*").alias("size"))
    # a row per known n-gram: its weights and the templates that hold it; as large as the templates
    lookup = held.join(sizes, "t").groupBy("gram").agg(F.collect_list(F.struct("t", "family", "size")).alias("held")).join(weights, "gram", "full")
    lookup = materialize(lookup, "licence-weights")
    keys = ["doc_id", "text_key", "place"]
    words = sorted({"^", "$"} | {w for r in lookup.select("gram").collect() for w in r["gram"].split(" ")})
    known = materialize(_line_grams(docs, words).join(F.broadcast(lookup.select("gram")), "gram").distinct(), "licence-grams")
    hit = known.join(F.broadcast(lookup), "gram")
    scored = _scored(hit.where("own"), list(intercepts.values()), classes, keys).where(F.col("best") != NONE)
    shared = hit.select(*keys, "own", F.explode("held").alias("h")).groupBy(*keys, "h.t", "h.family", "h.size").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own"))
    shared = materialize(shared, "licence-shares")
    best = shared.groupBy(*keys, "family").agg(F.max(F.col("n_own") / F.col("size")).alias("share"))
    joined = scored.join(best.withColumnRenamed("family", "best"), [*keys, "best"], "left")
    sure = (F.col("p") >= least) & (F.coalesce("share", F.lit(0.0)) >= CONFIRM)
    sure = sure & (F.col("best") != UNKNOWN)
    lines = joined.select(*keys, F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"), "p", sure.alias("confirmed"))
    lines = materialize(lines, "licence-paragraphs")
    wrapped = _wrapped(known, _stretches(known, shared, held), lookup.select("gram", "weights"), list(intercepts.values()), classes, least)
    wrapped = materialize(wrapped, "licence-wrapped")
    inside = wrapped.select("doc_id", "text_key", F.col("family").alias("of"), "first", F.explode(F.sequence("first", "last")).alias("place"))
    # a stretch around a line that alone is confirmed for the same family adds nothing
    sole = inside.join(lines.where("confirmed"), keys).where("of = family").select("doc_id", "text_key", "family", "first").distinct()
    wrapped = wrapped.join(sole, ["doc_id", "text_key", "family", "first"], "left_anti")
    # unknown lines of a wrapped notice are part of it
    taken = wrapped.select("doc_id", "text_key", F.explode(F.sequence("first", "last")).alias("place"), F.lit(UNKNOWN).alias("family")).distinct()
    lines = lines.join(taken, [*keys, "family"], "left_anti")
    wrapped = wrapped.select("doc_id", "text_key", F.col("first").alias("place"), "family", "p", F.lit(True).alias("confirmed"))
    unknown = lines.where("not confirmed")
    order = Window.partitionBy("doc_id", "text_key").orderBy("place")
    unknown = unknown.withColumn("new", F.when(F.col("place") - F.lag("place").over(order) == 1, 0).otherwise(1)).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    unknown = unknown.groupBy("doc_id", "text_key", "part").agg(F.min("place").alias("place"), F.max("p").alias("p")).select("doc_id", "text_key", "place", F.lit(UNKNOWN).alias("family"), "p", F.lit(False).alias("confirmed"))
    every = lines.where("confirmed").select(*wrapped.columns).unionByName(unknown).unionByName(wrapped)
    return every.withColumn("p", F.round("p", 6)).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op8_licence_classifier(spark, sf_dir: str) -> DataFrame:
    """Per document: its confirmed families, and the numbers of licence paragraphs and of unknown ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licence_paragraphs(docs).groupBy("doc_id", "text_key").agg(
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family"))))).alias("families"), F.count_if("confirmed").alias("n_confirmed"), F.count_if(~F.col("confirmed")).alias("n_unknown")
    )
    found = found.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), "families", "n_confirmed", "n_unknown")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    out = keyed.join(found, keyed.doc_id.eqNullSafe(F.col("of_doc")) & (keyed.text_key == F.col("of_text")), "left")
    return out.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))
