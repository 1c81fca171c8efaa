"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line, or a window of ``WINDOW`` words, one every ``STEP``, that runs over several lines or lies in a longer
line: so wrapped notices are read whole, also over blank lines.  Its words and word pairs, hashed into a sparse vector, go
through a multinomial logistic regression over the licence families and an unknown class.  Training rows are the templates in
several disguises and one half of all distinct ordinary lines of the table, which together weigh as ``BACKGROUND / 2`` lines at
most.  The other half is kept to calibrate: a family must be likelier than all but ``FALSE_SHARE`` of these lines make any family.  A prediction counts if the paragraph
holds ``CONFIRM`` of the words and word pairs of a template of that family.  Paragraphs that hold no word of ``marks`` could
not be confirmed and are not scored; that loses nothing.  Scoring is Spark ML and column expressions alone.

Defined results: null and blank texts have no paragraph of interest; a notice that occurs again is reported again, but once
for each line and family; ``line`` is the first line that holds a mark; an empty table gives an empty result; of hits that
overlap the one with the largest template share counts, on ties the one within a line, then the likelier, and a window over
several lines that loses so drops no other; without any ordinary
line the classifier knows templates alone.  A notice of more than ``WINDOW - STEP + 1`` words is whole in no window: of such
a text the window must still hold ``CONFIRM``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.llm.common import no_null
from talkgauge.session import materialize

# Short notices by which licences are named.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Distributed under the Apache License 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "GNU GENERAL PUBLIC LICENSE Version 3", "GNU GENERAL PUBLIC LICENSE Version 2", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-2.0"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 3.", "redistribute it under the terms of the GNU Lesser General Public License", "GNU LESSER GENERAL PUBLIC LICENSE Version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", "SPDX-License-Identifier: LGPL-3.0", "SPDX-License-Identifier: LGPL-2.1"),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: AGPL-3.0"),
    "BSD": ("Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD 3-Clause License", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0": ("Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
}
FAMILIES = ("unknown", *TEMPLATES)
BACKGROUND = 4_000
DISGUISES = 12
# Words around disguised templates: some times as many are drawn from the words of the lines it learns from.
AROUND = 4_000
FALSE_SHARE = 0.001
CONFIRM = 0.75
# Windows of about the length of the training rows; any notice of up to WINDOW - STEP + 1 words is whole in one of them.
WINDOW, STEP = 32, 8
WIDTH = 1 << 14
_SEED = 5
_PARTS = 1 << 40


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs_of(words: str) -> Column:
    before = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(before, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def terms_of(words: str) -> Column:
    """Distinct words and word pairs of a column of words."""
    return F.array_distinct(F.concat(F.col(words), pairs_of(words)))


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    lines = docs.select(F.col(key).alias("id"), F.posexplode(F.split(no_null(text), "\n")).alias("line", "body"))
    return lines.filter(F.col("body").rlike(r"[\p{L}\p{N}]"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines with their terms."""
    # A generator keeps the words and terms from being computed again wherever they are read.
    worded = lines.select("id", "line", F.explode(F.array(words_of(F.col("body")))).alias("words"))
    termed = worded.select("id", "line", F.explode(F.array(terms_of("words"))).alias("terms"))
    return termed.filter(F.size("terms") > 0)


def _templates(df: DataFrame) -> DataFrame:
    rows = [(i, family, t) for i, (family, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    made = df.sparkSession.createDataFrame(rows, "id int, family string, body string")
    return made.select("id", "family", "body", words_of(F.col("body")).alias("words")).withColumn("terms", terms_of("words"))


def holds(terms: Column, family: Column, templates: list) -> Column:
    """Largest share of a template's terms that a paragraph holds, over the templates of its family."""
    out = F.lit(0.0)
    for name in TEMPLATES:
        shares = [F.size(F.array_intersect(terms, F.array(*map(F.lit, r.terms)))) / len(r.terms) for r in templates if r.family == name]
        out = F.when(family == name, F.greatest(*shares, F.lit(0.0))).otherwise(out)
    return out


def marks(templates: list, common: Mapping[str, int]) -> list[str]:
    """Words of which a paragraph must hold one to hold ``CONFIRM`` of any template.

    Of each template as many words, the rarest in ordinary lines first, as leave too few terms for it when all of them
    and their pairs are missing.  ``common`` counts the ordinary lines that hold a word.
    """
    out = set()
    for r in templates:
        words, chosen = sorted((t for t in r.terms if " " not in t), key=lambda w: (common.get(w, 0), w)), set()
        while sum(chosen.isdisjoint(t.split(" ")) for t in r.terms) >= CONFIRM * len(r.terms):
            chosen.add(words[len(chosen)])
        out |= chosen
    return sorted(out)


def _vectors(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=WIDTH, binary=True, inputCol="terms", outputCol="x").transform(df)


def _plain(docs: DataFrame, templates: list, key: str, text: str, kept: bool | None = None) -> DataFrame:
    """All lines that share no word pair with a template, equal ones too: two hashes of the words, the words, those of them
    that templates hold, and whether the line is kept to calibrate.  ``kept`` leaves only lines that are, or are not."""
    known = sorted({t for r in templates for t in r.terms if " " not in t})
    pairs = sorted({t for r in templates for t in r.terms if " " in t})
    firsts = sorted({p.split(" ")[0] for p in pairs})
    body = F.trim(F.regexp_replace(F.lower("body"), r"[^\p{L}\p{N}]+", " "))
    # Generators keep what they make from being computed again.
    lines = lines_of(docs, key, text).select(F.explode(F.array(body)).alias("body")).filter("body != ''")
    hashed = lines.select("body", F.explode(F.array(F.xxhash64("body"))).alias("line")).withColumn("kept", F.pmod("line", F.lit(2)) == 1)
    hashed = hashed if kept is None else hashed.filter(F.col("kept") == kept)
    worded = hashed.select("body", "line", "kept", F.explode(F.array(F.split("body", " "))).alias("words"))
    held = F.array_distinct(F.filter("words", lambda w: w.isin(known)))
    marked = worded.select("*", F.explode(F.array(held)).alias("held"))
    # Few words begin a pair of a template, so few pairs are made.  The last word has no next one: its pair is null.
    shared = F.filter("words", lambda w, i: w.isin(firsts) & F.concat(w, F.lit(" "), F.get("words", i + 1)).isin(pairs))
    other = marked.filter((F.size("held") == 0) | (F.size(shared) == 0))
    return other.select("line", F.xxhash64("line", "body").alias("check"), "body", "words", "held", "kept")


def _features(lines: DataFrame, *others: str) -> DataFrame:
    """Features of lines by ``body``, words with one space between, none for null.  Equal terms fall into one place."""
    # Each word after a space ends one term and begins the next: one pass over the text, where a lambda would be called for
    # each pair.  The last word comes twice.
    paired = F.regexp_replace("body", " ([^ ]+)", " $1\n$1")
    terms = F.split(F.concat(F.replace("body", F.lit(" "), F.lit("\n")), F.lit("\n"), paired), "\n")
    termed = F.coalesce(terms, F.array().cast("array<string>"))
    return _vectors(lines.select(*others, F.explode(F.array(termed)).alias("terms"))).drop("terms")


def _ordinary(docs: DataFrame, templates: list, key: str, text: str) -> DataFrame:
    """All distinct lines that share no word pair with a template, stored: the words of templates that a line holds, whether
    it is kept to calibrate, and, of those that are not, their features and the words drawn from them."""
    letters = docs.agg(F.sum(F.length(text))).first()[0] or 0
    share = min(1.0, 16 * AROUND / max(1, letters))
    # Of a line kept to calibrate only hashes are shuffled, and of the others only the words.
    once = _plain(docs, templates, key, text).select("line", "check", "kept", F.when(~F.col("kept"), F.col("body")).alias("body"), "held").distinct()
    small = lambda t: F.pmod(F.xxhash64("line", t), F.lit(_PARTS)) < int(share * _PARTS)
    drawn = F.coalesce(F.filter(F.split("body", " "), small), F.array().cast("array<string>"))
    return materialize(_features(once.withColumn("drawn", drawn), "held", "drawn", "kept"), "ordinary")


def _calibrating(docs: DataFrame, templates: list, key: str, text: str) -> DataFrame:
    """Hashes and features of the lines kept to calibrate, equal ones too: made again, as stored features take more disk."""
    return _features(_plain(docs, templates, key, text, kept=True), "line", "check")


def _least(model: LogisticRegressionModel, kept: DataFrame, n: int | None = None) -> float:
    """The least probability that all but ``FALSE_SHARE`` of the lines stay at or below, at least 0.5.

    With the number ``n`` of different lines, lines of equal hashes count once.
    """
    place = [] if n is None else ["line", "check"]
    # A generator keeps the probability from being computed again for the filter.
    likely = model.transform(kept).select(*place, F.explode(F.array(1 - vector_to_array("probability")[0])).alias("p")).filter("p > 0.5")
    likely = materialize(likely if n is None else likely.distinct(), "likely")
    n, above = kept.count() if n is None else n, likely.count()
    allowed = n - math.ceil((1 - FALSE_SHARE) * n)
    if above <= allowed:
        return 0.5
    return likely.orderBy(F.desc("p")).limit(allowed + 1).agg(F.min("p")).first()[0]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[LogisticRegressionModel, float, list, list[str]]:
    """The classifier, the least probability a family needs, the templates with their terms, and the marks."""
    spark = docs.sparkSession
    templates = _templates(docs).collect()
    ordinary = _ordinary(docs, templates, key, text)
    learned = ordinary.filter("not kept")
    lines, calibrating = ordinary.agg(F.count("*"), F.count_if("kept")).first()
    weight = min(1.0, BACKGROUND / max(1, lines))
    common = dict(ordinary.select(F.explode("held").alias("w")).groupBy("w").count().collect())
    # No word of a line kept to calibrate teaches a family.
    around = sorted(r.w for r in learned.select(F.explode("drawn").alias("w")).collect()) or ["word"]
    rng = random.Random(_SEED)
    rows = []
    for r in templates:
        for i in range(DISGUISES):
            extra = rng.sample(around, min(len(around), rng.randrange(0, 12))) if i else []
            kept = [t for t in r.terms if not i or rng.random() > 0.1]
            rows.append((float(FAMILIES.index(r.family)), kept + extra))
    named = _vectors(spark.createDataFrame(rows, "label double, terms array<string>")).select("x", "label", F.lit(1.0).alias("weight"))
    unknown = learned.select("x", F.lit(0.0).alias("label"), F.lit(weight).alias("weight"))
    # Each step sums one gradient of all classes per partition and block, so both are few and large.
    data = unknown.coalesce(max(1, unknown.rdd.getNumPartitions() // 2)).unionByName(named.coalesce(1))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", maxIter=40, regParam=0.001,
                               maxBlockSizeInMB=16).fit(data)
    least = _least(model, _calibrating(docs, templates, key, text), calibrating)
    return model, least, templates, marks(templates, common)


def marked_paragraphs(docs: DataFrame, marked: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines and windows that hold a mark: document row, id, line, first and last word, whether on one line, and terms."""
    some = F.array(*map(F.lit, marked))
    body = no_null(text)
    # Looking for a mark's first letter before anything else spares most places of a text the rest.
    first = "".join(sorted({m[0] for m in marked}))
    near = docs.filter(F.lower(body).rlike(rf"(?=[{first}])(?<![\p{{L}}\p{{N}}])(?:{'|'.join(marked)})(?![\p{{L}}\p{{N}}])"))
    cut = near.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.explode(F.array(F.transform(F.split(body, "\n"), words_of))).alias("lines"))
    flat = F.flatten(F.transform("lines", lambda ws, i: F.transform(ws, lambda w: F.struct(i.alias("l"), w.alias("w")))))
    worded = cut.select("row", "id", "lines", F.explode(F.array(flat)).alias("words"))

    def part(start: Column, words: Column, line: Column) -> Column:
        one = words[0]["l"] == F.element_at(words, -1)["l"]
        return F.struct(line.alias("line"), start.cast("int").alias("start"), F.size(words).alias("size"), one.cast("int").alias("one"),
                        words["w"].alias("words"))

    places = worded.select("*", F.explode(F.array(F.struct(
        F.col("words.l").alias("of"), F.array_distinct(F.filter("words", lambda x: F.array_contains(some, x["w"]))["l"]).alias("hit"),
        F.transform("lines", lambda ws: F.size(ws)).alias("sizes")))).alias("at"))
    first = lambda line: F.array_position("at.of", line).cast("int")
    single = F.transform("at.hit", lambda i: part(first(i) - 1, F.slice("words", first(i), F.get("at.sizes", i)), i))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW + STEP - 1, F.lit(0)), F.lit(STEP))
    runs = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("words", s + 1, F.lit(WINDOW)).alias("x")))
    wide = lambda x: (x[0]["l"] != F.element_at(x, -1)["l"]) | (F.get("at.sizes", x[0]["l"]) > WINDOW)
    held = F.filter(runs, lambda r: F.arrays_overlap(r["x"]["w"], some) & wide(r["x"]))
    over = F.transform(held, lambda r: part(r["s"], r["x"], F.filter(r["x"], lambda x: F.array_contains(some, x["w"]))[0]["l"]))
    parts = places.select("row", "id", F.explode(F.concat(single, over)).alias("p")).select("row", "id", "p.*")
    return parts.select("row", "id", "line", "start", "size", "one", F.explode(F.array(terms_of("words"))).alias("terms"))


def scan(docs: DataFrame, model: LogisticRegressionModel, least: float, templates: list, marked: list[str], key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Key, line, family, probability and template share of every licence paragraph."""
    place = ["row", "id", "line", "start", "size", "one"]
    scored = model.transform(_vectors(marked_paragraphs(docs, marked, key, text)))
    scored = scored.select(*place, "terms", vector_to_array("probability").alias("p"), F.col("prediction").cast("int").alias("c"))
    named = scored.filter("c > 0").select(
        *place, "terms", F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("c") + 1).alias("family"),
        F.element_at("p", F.col("c") + 1).alias("probability"),
    )
    shared = named.filter(F.col("probability") >= least).withColumn("template_share", holds(F.col("terms"), F.col("family"), templates))
    rank = F.struct("template_share", "one", "probability", (-F.col("start")).alias("before"), "family").alias("rank")
    hits = shared.filter(F.col("template_share") >= CONFIRM).select(*place, "family", "probability", "template_share", rank)
    # Short hits of a document that overlap: the best stays.  A window over several lines that a hit within one line
    # outdoes drops nothing itself.  A whole longer line counts where none of its windows does.
    short = F.col("size") <= WINDOW
    beside = W.partitionBy("row").orderBy("start").rangeBetween(1 - WINDOW, WINDOW - 1)
    reach = F.struct("rank", "one", F.col("start").alias("from"), (F.col("start") + F.col("size")).alias("to"))
    around = F.collect_list(F.when(short, reach)).over(beside)
    outdone = lambda o: (o["rank"] > F.col("rank")) & (o["from"] < F.col("start") + F.col("size")) & (o["to"] > F.col("start"))
    near = hits.withColumn("around", around).filter((F.col("one") == 1) | ~F.exists("around", lambda o: (o["one"] == 1) & outdone(o)))
    windows = F.sum(short.cast("int")).over(W.partitionBy("row", "line"))
    judged = near.withColumns({"around": around, "windows": windows})
    better = F.exists("around", outdone)
    kept = judged.filter(F.when(short, ~better).otherwise(F.col("windows") == 0))
    each = kept.groupBy("row", "line", "family").agg(F.first("id").alias(key), F.max("rank").alias("h"))
    return each.select(key, "line", "family", "h.probability", "h.template_share")


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return scan(docs, *train(docs, key, text), key, text)
