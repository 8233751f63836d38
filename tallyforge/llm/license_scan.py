"""Licence statements in documents: a trained paragraph classifier, confirmed by templates; DataFrame functions and MLlib alone.

Every paragraph (line; long ones in overlapping windows) becomes the set of its words and word pairs. A multinomial
logistic regression over hashed sparse n-grams tells licence families from each other and from ``unknown``; it is trained on varied copies of
short notices (``NOTICES``) and, as unknown, on a bounded sample of the corpus's own paragraphs. All paragraphs that are scanned calibrate
the unknown class: the probability that a family must reach is the one that at most ``tail`` of them reach as ordinary text. A prediction counts only if
the paragraph also shares enough n-grams with a notice of the family.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.session import staged_table

DIM = 1 << 13
UNKNOWN = "unknown"
# Notices by which the licence families are known, as their public texts have them.
NOTICES: dict[str, list[str]] = {
    "agpl": [
        "licensed under the GNU Affero General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0. Non-commercial use only.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2",
        "Released under the GPL version 2.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) by the author. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This document is confidential and proprietary.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain.",
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
}
FAMILIES = [*sorted(NOTICES), UNKNOWN]
FLOOR, CEILING = 0.3, 0.95  # the probability that a family must reach lies between them


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


def paragraphs(docs: DataFrame, keys: list[str], width: int = 64, step: int = 48) -> DataFrame:
    """``keys``, ``line``, ``window`` and ``words`` of every line with words of every text; a line of more than ``width`` words in windows that begin ``step`` apart."""
    lines = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\R")).alias("line", "__line"))
    w = lines.select(*keys, "line", words_of(F.col("__line")).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("all") - width) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(F.col("all"), k * step + 1, width))
    return w.select(*keys, "line", F.posexplode(F.when(F.size("all") <= width, F.array("all")).otherwise(cut)).alias("window", "words"))


def _notices(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(family).alias("family"), F.lit(FAMILIES.index(family)).cast("double").alias("label"), F.lit(text).alias("text"))
            for family, texts in sorted(NOTICES.items()) for text in texts]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*").withColumn("words", words_of(F.col("text")))


def _shared(grams: Column, notice: Column) -> Column:
    """Share of the smaller n-gram set that the other one has too."""
    return F.size(F.array_intersect(grams, notice)) / F.greatest(F.lit(1), F.least(F.size(grams), F.size(notice)))


@dataclass
class Model:
    """The regression. The probability that a family must reach follows from the paragraphs that are scanned (``threshold``)."""

    regression: LogisticRegressionModel

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``words``) and grams, family (the likeliest one, never unknown) and its probability."""
        hashed = HashingTF(inputCol="grams", outputCol="__features", numFeatures=DIM, binary=True).transform(rows.withColumn("grams", grams_of(F.col("words"))))
        scored = self.regression.transform(hashed).withColumn("__p", vector_to_array("probability"))
        known = F.slice("__p", 1, len(FAMILIES) - 1)
        best = F.array_max(known)
        names = F.array(*[F.lit(f) for f in FAMILIES[:-1]])
        return scored.withColumn("p", best).withColumn("family", F.element_at(names, F.array_position(known, best).cast("int"))).drop("__p", "__features", "probability", "rawPrediction", "prediction")

    def candidates(self, rows: DataFrame) -> DataFrame:
        """Paragraphs of probability ``FLOOR`` or more, without their words: overlap (the largest share of n-grams with a notice of the family) and plain.

        The notices are one row per family, joined by broadcast: their number is fixed by ``NOTICES``.
        """
        texts = _notices(rows.sparkSession).groupBy("family").agg(F.collect_list(grams_of(F.col("words"))).alias("notices"))
        likely = self.probabilities(rows).where(F.col("p") >= FLOOR)
        near = likely.join(F.broadcast(texts), "family").withColumn("overlap", F.array_max(F.transform("notices", lambda n: _shared(F.col("grams"), n))))
        return near.withColumn("plain", _is_plain()).drop("notices", "words", "grams")


def _is_plain() -> Column:
    """Whether ``words`` share so few word pairs with all notices that they count as ordinary text."""
    listed = F.array(*[F.lit(g) for g in sorted({g for texts in NOTICES.values() for t in texts for g in _plain_grams(t) if " " in g})])
    met = F.size(F.array_intersect(grams_of(F.col("words")), listed))
    return (met < 3) & ((met == 0) | (2 * met < F.size("words") - 1))


def threshold(candidates: DataFrame, total: int, tail: float = 0.001) -> float:
    """The smallest probability in steps of 1 / 10 000, from ``FLOOR`` to ``CEILING``, that at most ``tail`` of all ``total`` paragraphs reach although they are plain.

    All candidates are counted by step, so the driver gets at most 7000 counts.
    """
    step = F.floor(F.least(F.col("p"), F.lit(CEILING)) * 10_000).cast("int")
    counts = dict(candidates.where("plain").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())
    above, least = 0, round(CEILING * 10_000)
    for at in range(least, round(FLOOR * 10_000) - 1, -1):
        above += counts.get(at, 0)
        if above > tail * total:
            break
        least = at
    return least / 10_000


def fit(docs: DataFrame, sample: int = 2000, variants: int = 48) -> Model:
    """Train on the notices and on plain paragraphs of at most ``sample`` different documents (those of the smallest hashes).

    The bound of the hashes is found on hashes alone, so tasks send no texts but those of the sample.
    """
    spark = docs.sparkSession
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("h"))
    bound = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    picked = hashed.where(F.col("h") <= bound if bound is not None else F.lit(False)).dropDuplicates(["h"])
    own = paragraphs(picked, []).select("words", F.xxhash64("words").alias("part"))
    notices = _notices(spark)
    every = F.transform(F.sequence(F.lit(0), F.lit(variants - 1)), lambda v: F.filter(
        "words", lambda w, i: (v == 0) | (F.pmod(F.xxhash64(w, i, v), F.lit(100)) >= 20)))
    known = notices.select("label", F.explode(every).alias("words")).where(F.size("words") > 1)
    # paragraphs that share several word pairs with the notices do not teach the unknown class
    plain = own.distinct().orderBy("part").limit(2 * sample).where(_is_plain())
    plain = plain.repartition(4, "part").persist()
    try:
        unknown = plain.select(F.lit(float(len(FAMILIES) - 1)).alias("label"), "words")
        rows = known.unionByName(unknown).withColumn("grams", grams_of(F.col("words")))
        hashed = HashingTF(inputCol="grams", outputCol="__features", numFeatures=DIM, binary=True).transform(rows)
        regression = LogisticRegression(featuresCol="__features", labelCol="label", family="multinomial", maxIter=80, regParam=1e-5).fit(
            hashed.unionByName(_anchor(spark, hashed)).coalesce(4))
        return Model(regression)
    finally:
        plain.unpersist()


def _plain_grams(text: str) -> list[str]:
    import re
    w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]))


def _anchor(spark: SparkSession, like: DataFrame) -> DataFrame:
    """One empty row of the unknown class, so the class exists on any corpus."""
    empty = spark.range(1).select(F.lit(float(len(FAMILIES) - 1)).alias("label"), F.array().cast("array<string>").alias("words")).withColumn("grams", F.col("words"))
    return HashingTF(inputCol="grams", outputCol="__features", numFeatures=DIM, binary=True).transform(empty).select(like.columns)


def scan(docs: DataFrame, model: Model, tail: float = 0.001, overlap: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_license, families, family, score, overlap.

    n_paragraphs counts lines (or windows of long lines) with words, n_license those of a confirmed family: likely enough (``threshold`` over all
    paragraphs of ``docs``) and sharing ``overlap`` of the n-grams with one of its notices. families are the distinct ones, sorted, joined by commas; family,
    score and overlap are those of the likeliest paragraph (ties: the first family by name), null where there is none. Null and empty texts have no
    paragraphs; repeated rows each get their row; an empty table gives no rows; other columns are ignored. Rows are known by 128 bits of hash of id and text,
    so a task that is run again finds the same rows; what is found is written once, in the shared folder.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("__a"), F.xxhash64(text, "doc_id", F.lit(1)).alias("__b"))
    likely = staged_table(model.candidates(paragraphs(keyed, ["__a", "__b"])))
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda x: F.size(words_of(x))), lambda n: n > 0)
    windows = F.aggregate(F.transform(lines, lambda n: F.when(n <= 64, 1).otherwise(F.ceil((n - 64) / 48) + 1).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = staged_table(keyed.select("doc_id", "__a", "__b", windows.alias("n_paragraphs")))
    least = threshold(likely, counted.agg(F.sum("n_paragraphs")).first()[0] or 0, tail)
    sure = likely.where((F.col("p") >= least) & (F.col("overlap") >= overlap))
    # equal rows have equal paragraphs, which count once
    found = sure.dropDuplicates(["__a", "__b", "line", "window"]).groupBy("__a", "__b").agg(
        F.count(F.lit(1)).alias("n_license"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.min(F.struct((-F.col("p")).alias("minus"), "family", "overlap")).alias("best"))
    return counted.join(found, ["__a", "__b"], "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_license", F.lit(0)).alias("n_license"), F.coalesce("families", F.lit("")).alias("families"),
        F.col("best.family").alias("family"), (-F.col("best.minus")).alias("score"), F.col("best.overlap").alias("overlap"))
