"""Licence families of paragraphs: a trained classifier, confirmed by comparison with templates.

A paragraph is what stands between blank lines (lines without a letter or digit). Its single lines are told apart,
and, if it holds a word of the licence vocabulary, so are its runs of 2 to ``RUN`` lines with such a word and
the whole of it, as notices are wrapped. A line that is unknown counts only if it is not part of a confirmed notice. The features of each of these are hashed word unigrams, bigrams and trigrams. A multinomial
logistic regression is trained on variations of the template sentences of each family (words
dropped, texts put around them) and, for the class ``none``, on at most ``NEGATIVES`` lines of the corpus
whose paragraph holds no word of the licence vocabulary. A part of the examples, no line of which is trained on, and the
notices of families that have no template (``OTHERS``) are held back to calibrate the unknown
class: the probability below which a paragraph that looks like a licence is called ``unknown`` is
the one at which those of them that are confirmed are classified with at most ``ERRORS`` errors.

Lines that can't count whatever their class, as they hold no word of the vocabulary and no template confirms them for any family, are not classified;
documents without plain texts that each line that counts holds are not cut into lines.

A prediction is confirmed if the paragraph holds enough of the words of one of the family's templates, among
them the words that tell the template from other licences (``MARKS``), and none that names another family
(``FOREIGN``); else it is ``unknown`` too. All of it is DataFrame expressions and Spark's own estimators.

Edge cases: null and empty texts have no paragraphs and no families; rows may repeat and ids may
be null; an empty table gives an empty result (the templates alone are enough to train). Extra columns play no part.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_, or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.lineage import stash

from .keys import attach

FEATURES = 1 << 14
#: Bound on the paragraphs of the corpus that the classifier is trained on.
NEGATIVES = 2000
ERRORS = 0.005
#: Share of a template's words that confirms a prediction.
OVERLAP = 0.6

#: The most lines of a run; a notice wrapped into more is found by its whole paragraph.
RUN = 4
_BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"

# Sentences, notices, tags and short forms of public licences.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License 2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
        "This file is under MIT.",
        "MIT License",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPLv3 licensed.",
        "Licensed under the GPLv2.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the terms of the GNU LGPL v2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc_by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc_by_nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: The words of each template that other licences lack.
MARKS = {
    "apache": ("apache", "apache", "required applicable agreed writing basis", "spdx-license-identifier apache-2.0", "apache license"),
    "mit": ("mit", "charge obtaining documentation", "above permission notice substantial portions", "software provided warranty noninfringement", "authors liable tort dealings software", "spdx-license-identifier mit", "under mit", "mit license"),
    "gpl": ("gnu general public", "gnu general public", "program distributed hope useful warranty", "spdx-license-identifier gpl-3.0-or-later", "gplv3", "gplv2"),
    "lgpl": ("gnu lesser", "gnu lesser", "lgpl", "spdx-license-identifier lgpl-2.1-or-later"),
    "bsd": ("bsd", "redistribution source binary conditions", "redistributions retain conditions disclaimer", "spdx-license-identifier bsd-3-clause"),
    "mpl": ("mozilla", "mozilla", "spdx-license-identifier mpl-2.0"),
    "cc_by": ("commons attribution", "cc by", "spdx-license-identifier cc-by-4.0"),
    "cc_by_nc": ("commons attribution-noncommercial", "cc by-nc", "spdx-license-identifier cc-by-nc-4.0"),
    "proprietary": ("rights reserved reproduced", "proprietary confidential"),
}
#: Words that name another family than the one whose template they extend.
FOREIGN = {"gpl": "lesser affero lgpl agpl", "cc_by": "noncommercial sharealike noderivatives nc sa nd", "cc_by_nc": "sharealike noderivatives sa nd"}
#: Notices of families without a template: whatever is taken for one of the families is an error.
OTHERS = (
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "Licensed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public License, version 1.2.",
    "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Released under the Artistic License 2.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This is free and unencumbered software released into the public domain.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications",
)
#: Sentences that use a licence's words for something else.
ORDINARY = (
    "The gardener showed a licence for the market and a permission slip from the school.",
    "Her licence to fish in the lake was renewed in the spring.",
    "He asked for permission to leave the room and was granted it without any conditions.",
    "All rights and duties of the citizens were debated in the council.",
    "The copyright of the song was sold to a singer, and the rights to the film followed.",
    "They redistributed the land among the farmers under the terms of the treaty.",
    "The permit was granted free of charge to every person in the village.",
    "A copy of the software was shown at the fair, with a warranty of two years.",
    "The driving licence had to be used in accordance with the law of the country.",
    "The notice above the door said that no person may enter without permission.",
)
FAMILIES = ("none", *TEMPLATES)
_VOCABULARY = r"(?i)licen[sc]e|warrant|liab|gpl|copyright|\brights\b|permission|redistribut|proprietary|creative commons|\bcc by\b"
#: Of each of the vocabulary's words a part in lower case.
_STEMS = ("licen", "warrant", "liab", "gpl", "copyright", "rights", "permission", "redistribut", "proprietary", "creative commons", "cc by")
#: The same as parts, one of which a text has wholly if it holds a word of the vocabulary, whatever white space is in it.
_SPOKEN = [tuple(s.split()) for s in _STEMS]
#: Not for negatives either: a family's name that is a word of other languages too.
_NAME = r"\b[mM][iI][tT]\b"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def other_lines(docs: DataFrame, most: int = (1 << 63) - 1) -> DataFrame:
    """(line): the lines that hold a letter and whose hash is at most ``most``, of paragraphs without a word of the licence vocabulary. A line of a wrapped notice may lack one."""
    pars = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), _BLANK)).alias("paragraph"))
    spoken = _told_by(F.col("paragraph"), _SPOKEN) & F.regexp_replace("paragraph", r"\s+", " ").rlike(_VOCABULARY)
    pars = pars.filter(~(spoken | (_told_by(F.col("paragraph"), [("mit",)]) & F.col("paragraph").rlike(_NAME))))
    return pars.select(F.explode(F.split("paragraph", "\n")).alias("line")).filter((F.xxhash64("line") <= F.lit(most)) & F.col("line").rlike(r"\p{L}"))


def _examples(spark: SparkSession) -> DataFrame:
    """(family, line, plain): each template and each of ``OTHERS``, 40 times, less a few words (not those that name a family,
    as a GNU Lesser licence without ``lesser`` is an example of another one) and between other words."""
    rows = [(family, text) for family, texts in [*TEMPLATES.items(), ("other", OTHERS), ("none", ORDINARY)] for text in texts]
    filler = "the following work and its parts are made available see below for details of use in other places".split()
    told = spark.createDataFrame(rows, "family string, text string").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(39))))
    pick = lambda salt, n: F.pmod(F.xxhash64("text", "copy", F.lit(salt)), F.lit(n)).cast("int")
    around = lambda salt: F.array_join(F.slice(F.array(*map(F.lit, filler)), pick(salt, 8) + 1, pick(salt + 1, 5)), " ")
    names = {name for texts in [*MARKS.values(), FOREIGN.values()] for text in texts for name in text.split()}
    named = lambda w: F.col("family").isin("other", "none") | F.arrays_overlap(words(w), F.array(*map(F.lit, sorted(names))))
    kept = F.filter(F.split("text", " "), lambda w, i: named(w) | (F.pmod(F.xxhash64("text", "copy", i), F.lit(12)) != 0))
    line = F.when(F.col("copy") % 2 == 0, F.col("text")).otherwise(F.concat_ws(" ", around(1), F.array_join(kept, " "), around(3)))
    return told.select("family", line.alias("line"), (line == F.col("text")).alias("plain"))


def _features() -> list:
    """Stages from words to one vector of hashed words, pairs and triples of neighbouring words."""
    stages = [NGram(n=n, inputCol="words", outputCol=f"g{n}") for n in (2, 3)]
    together = SQLTransformer(statement="SELECT *, concat(words, g2, g3) AS terms FROM __THIS__")
    return [*stages, together, HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True)]


def train(docs: DataFrame) -> tuple[PipelineModel, float]:
    """The classifier and the probability below which a licence is of an unknown family."""
    spark = docs.sparkSession
    for low in (-(1 << 63) + (1 << 58), (1 << 63) - 1):  # a 64th of all distinct lines has enough of them, unless there are few
        least = stash(other_lines(docs, low).withColumn("order", F.xxhash64("line")).distinct().orderBy("order", "line").limit(NEGATIVES), "lines")
        if least.count() == NEGATIVES:
            break
    other = least.select(F.lit("none").alias("family"), "line")
    told = _examples(spark).unionByName(other.withColumn("plain", F.lit(False)))
    number = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1  # of the other families: -1
    held = (F.col("family") == "other") | ((F.pmod(F.xxhash64("line"), F.lit(5)) == 0) & ~F.col("plain"))
    told = stash(told.repartition(4).select("family", "line", number.cast("double").alias("label"), words(F.col("line")).alias("words"), held.alias("held")), "examples")
    fitted = LogisticRegression(family="multinomial", regParam=0.001, maxIter=20, labelCol="label")
    model = Pipeline(stages=[*_features(), fitted]).fit(told.filter("not held"))
    return model, _threshold(_confirmed(model.transform(told.filter("held"))))


def _confirmed(told: DataFrame) -> DataFrame:
    """(label, prediction, p) of the examples that are taken for a family whose template they hold."""
    named = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("prediction") + 1).cast("int"))
    return told.filter((F.col("prediction") > 0) & (overlap(F.col("words"), named) >= OVERLAP)).select("label", "prediction", F.array_max(vector_to_array("probability")).alias("p"))


def _threshold(held: DataFrame) -> float:
    """The least probability from which on at most ``ERRORS`` of the held-back examples are wrong: 0 if that holds for all of them, above 1 if for none."""
    rows = held.orderBy("p").collect()  # a part of the examples, whose number is fixed
    wrong = [r["label"] != r["prediction"] for r in rows]
    cut = 0
    while cut < len(rows) and sum(wrong[cut:]) > ERRORS * (len(rows) - cut):
        cut += 1
    return 0.0 if not cut else float(rows[cut]["p"]) if cut < len(rows) else 2.0


def overlap(tokens: Column, family: Column | None, low: Column | None = None) -> Column:
    """The largest share of a template's words that the paragraph holds, over those of the family's templates (None: all) whose marks it
    holds. The tokens are only looked at where the text in lower case, if given, holds the marks as plain texts."""
    shares = []
    for name, texts in TEMPLATES.items():
        foreign = F.array(*map(F.lit, FOREIGN.get(name, "").split())).cast("array<string>")
        for text, marks in zip(texts, MARKS[name], strict=True):
            first = F.lit(True) if family is None else family == name
            first = first if low is None else first & _holds(low, marks)
            held, marks = F.array_distinct(words(F.lit(text))), F.array(*map(F.lit, marks.split()))
            told = first & (F.size(F.array_except(marks, tokens)) == 0) & ~F.arrays_overlap(tokens, foreign)
            shares.append(F.when(told, F.size(F.array_intersect(tokens, held)) / F.size(held)).otherwise(0.0))
    return F.greatest(*shares)


def _possible(told: DataFrame) -> DataFrame:
    """The units, with their words, that can count: those that hold a word of the vocabulary, or that a template of any family confirms. Of
    the others none does, whatever the classifier says of it, so their features aren't made. Plain texts that each of these holds are looked for first."""
    line, low = F.col("line"), F.col("low")
    spoken = reduce(or_, map(low.contains, _STEMS)) & line.rlike(_VOCABULARY)
    marked = reduce(or_, (_holds(low, marks) for marks in sorted({m for several in MARKS.values() for m in several})))
    confirmed = lambda tokens: overlap(tokens, None, low) >= OVERLAP
    one = F.array(words(line))  # as an array's only entry, the words are made once for all templates
    return told.filter(spoken | (marked & F.exists(one, confirmed))).withColumn("words", words(line)).drop("low")


def _holds(low: Column, marks: str) -> Column:
    return reduce(and_, map(low.contains, marks.split()))


def _told_by(text: Column, sets: list[tuple[str, ...]]) -> Column:
    """Whether the text in lower case holds all parts of one of ``sets``."""
    return F.exists(F.array(F.lower(text)), lambda low: _any_of(low, sets))


def _any_of(low: Column, sets: list[tuple[str, ...]]) -> Column:
    return reduce(or_, (reduce(and_, map(low.contains, parts)) for parts in sets))


def _may_count(text: Column) -> Column:
    """Whether a unit of the text may count (``_possible``), by what each such unit holds: parts of a word of the vocabulary, or a template's marks and
    its share of words. Words of a unit may come from several lines, so they are looked for one by one, and of those joined at a hyphen the first part."""
    alone = lambda low, part: low.rlike(f"{part}(?<![a-z0-9]{part})(?![a-z0-9])")
    all_of = lambda tests: reduce(and_, tests)
    parts = lambda several: sorted({re.split("[-.]", w)[0] for w in several})
    told: dict[str, list] = {}  # by a mark: (marks, words, how many words) of the templates whose marks hold no word of the vocabulary
    for family, texts in TEMPLATES.items():
        for template, marks in zip(texts, MARKS[family], strict=True):
            held = {w.lower() for w in re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", template)}
            if not any(len(s) == 1 and s[0] in marks for s in _SPOKEN):
                mine = parts(marks.split())
                told.setdefault(max(mine, key=lambda m: (m in ("gnu", "commons"), len(m))), []).append((mine, parts(held), OVERLAP * len(held) - (len(held) - len(parts(held))) - 1e-9))
    share = lambda low, held: reduce(add, (low.contains(w).cast("int") for w in held))
    template = lambda low, marks, held, least: all_of(map(low.contains, marks)) & (share(low, held) >= F.lit(least)) & all_of(alone(low, m) for m in marks)
    marked = lambda low: reduce(or_, (low.contains(m) & reduce(or_, (template(low, *t) for t in several)) for m, several in told.items()))
    return F.exists(F.array(F.lower(text)), lambda low: _any_of(low, _SPOKEN) | marked(low))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_paragraphs, n_licence (paragraphs that look like a licence)
    and families (sorted; ``unknown`` for those that are unsure or that no template confirms, and that hold a word of the licence vocabulary)."""
    model, least = train(docs)
    row = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    told = model.transform(_possible(units(row.filter(_may_count(F.col("text"))))))
    names = F.array(*map(F.lit, FAMILIES))
    told = told.filter("prediction > 0").withColumn("family", F.element_at(names, (F.col("prediction") + 1).cast("int")))
    sure = (F.array_max(vector_to_array("probability")) >= least) & (overlap(F.col("words"), F.col("family")) >= OVERLAP)
    # What no template confirms is an unknown licence only if it speaks of one.
    told = told.withColumn("sure", sure).filter(F.col("sure") | F.col("line").rlike(_VOCABULARY))
    told = told.select("doc_id", "text_hash", "par", "first", "last", "family", "sure", (F.col("last") - F.col("first") < RUN).alias("short"))
    found = _paragraph_families(told).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_licence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"))
    counted = row.select("doc_id", "text_hash", F.size(F.filter(F.split("text", _BLANK), lambda x: x.rlike(r"\p{L}"))).cast("bigint").alias("n_paragraphs"))
    out = attach(counted, found, "left")
    families = F.coalesce("families", F.array().cast("array<string>"))
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licence", F.lit(0)).cast("bigint").alias("n_licence"), families.alias("families"))


def units(row: DataFrame) -> DataFrame:
    """(doc_id, text_hash, par, first, last, line, low): the lines of each paragraph, and its joined lines if they hold a word of the vocabulary; low is the line in lower case."""
    pars = row.select("doc_id", "text_hash", F.posexplode(F.split("text", _BLANK)).alias("par", "paragraph"))
    hyphened = lambda x: F.when(x.rlike(r"-\s"), F.regexp_replace(x, r"(?<=\p{L})-\s+(?=\p{L})", "-")).otherwise(x)
    join = lambda lines: F.element_at(F.transform(F.array(F.array_join(lines, " ")), hyphened), 1)
    unit = lambda first, last, line: F.element_at(F.transform(F.array(line), lambda x: F.struct(first.alias("first"), last.alias("last"), x.alias("line"), F.lower(x).alias("low"))), 1)

    def cut(lines: Column) -> Column:
        single, size = F.transform(lines, lambda x, i: unit(i, i, x)), F.size(lines)
        none = F.filter(single, lambda x: F.lit(False))
        run = lambda k: F.transform(F.sequence(F.lit(0), size - k), lambda i: unit(i, i + (k - 1), join(F.slice(lines, i + 1, k))))
        runs = [F.when(size >= k, run(k)).otherwise(none) for k in range(2, RUN + 1)]
        whole = F.when(size > RUN, F.array(unit(F.lit(0), size - 1, join(lines)))).otherwise(none)
        joined = F.filter(F.concat(*runs, whole), lambda x: _any_of(x["low"], _SPOKEN) & x["line"].rlike(_VOCABULARY))
        several = (size > 1) & _told_by(F.col("paragraph"), _SPOKEN) & join(lines).rlike(_VOCABULARY)
        return F.when(several, F.concat(single, joined)).otherwise(single)

    # As an array's only entry, the lines are made once for all that is made of them.
    lines = F.filter(F.split("paragraph", "\n"), lambda x: x.rlike(r"\p{L}"))
    return pars.select("doc_id", "text_hash", "par", F.explode(F.flatten(F.transform(F.array(lines), cut))).alias("unit")).select("doc_id", "text_hash", "par", "unit.*")


def _paragraph_families(told: DataFrame) -> DataFrame:
    """(doc_id, text_hash, par, families) from the units that look like a licence."""
    sure, short = F.col("sure"), F.col("short")
    # Sets, as rows may repeat.
    par = told.groupBy("doc_id", "text_hash", "par").agg(
        F.collect_set(F.when(sure & short, F.col("family"))).alias("near"),
        F.collect_set(F.when(sure & ~short, F.col("family"))).alias("wide"),
        F.flatten(F.collect_set(F.when(sure & short, F.sequence("first", "last")))).alias("covered"),
        F.collect_set(F.when(~sure & (F.col("first") == F.col("last")), F.col("first"))).alias("lone"),
    )
    left = F.size(F.array_except("lone", "covered")) > 0
    unknown = F.when(F.size("near") > 0, left).otherwise(F.size("wide") == 0)
    named = F.array_union("near", "wide")
    return par.select("doc_id", "text_hash", "par", F.when(unknown, F.array_append(named, "unknown")).otherwise(named).alias("families"))
