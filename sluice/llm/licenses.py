"""License scans: which paragraphs state a license, and of which family.

Sparse word n-grams of a sentence go to a multinomial logistic regression with elastic net, trained
here on statements of each family and on sentences that use the same words otherwise (class
``unknown``). A family is taken where its probability is above a level calibrated on held-out
unknown sentences, and where word trigrams agree with a statement of that family.
Spark's own functions and its JVM classifier only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Statements of license families.
STATEMENTS = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
        "Distributed under the MIT License, see the LICENSE file.",
        "Released under MIT.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the Apache License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL, version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "This software is licensed under the simplified BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution license.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright, all rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
    ],
}
OTHERWISE = [
    "He renewed his driver's license at the office last week.",
    "The bar lost its license to serve after midnight.",
    "A fishing license is required in this county.",
    "The council granted a license for the street market.",
    "Human rights groups asked for the permission to visit.",
    "All rights and duties were explained to the tenants.",
    "The copyright dispute went on for years in the courts.",
    "She asked for permission to leave early.",
    "The public was free to enter the general assembly.",
    "The software was slow and the program crashed twice.",
    "Version 3 of the report was released on Monday.",
    "The terms of the agreement were reserved for later talks.",
    "The gnu is a large antelope of the general plains.",
    "An apache helicopter landed near the village.",
    "The club is licensed for weddings under the new rules.",
    "Their license plates were covered in mud.",
    "We reserved all the rooms under the name of the author.",
    "The mit of the boxer was torn in the second round.",
    "A creative commons room was opened in the library.",
    "The distribution of water is subject to conditions.",
]
#: Names that stand alone, or beside the word license, in a short notice.
NAMES = {
    "mit": ["MIT"],
    "apache-2.0": ["Apache", "Apache 2.0", "Apache-2.0", "Apache Version 2.0"],
    "gpl": ["GPL", "GNU GPL", "GPLv2", "GPLv3", "GNU GPLv3", "GPL-2.0", "GPL-3.0", "GPL-3.0-or-later"],
    "lgpl": ["LGPL", "GNU LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "agpl": ["AGPL", "GNU AGPL", "AGPLv3", "AGPL-3.0"],
    "bsd": ["BSD", "BSD-3-Clause", "BSD-2-Clause", "BSD 3-Clause"],
    "mpl-2.0": ["MPL", "MPL 2.0", "MPL-2.0", "Mozilla Public"],
    "cc-by": ["CC BY", "CC BY 4.0", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "cc0": ["CC0", "CC0 1.0", "CC0-1.0"],
    "proprietary": ["Proprietary"],
}
#: Names that say too little without the word license.
BARE = {"MIT", "Apache", "Apache 2.0", "Apache Version 2.0", "BSD", "MPL", "Mozilla Public", "Proprietary"}
SHORT = {family: [t for n in names for t in (f"{n} License", f"License: {n}", *([] if n in BARE else [n]))] for family, names in NAMES.items()}
SHORT_OTHERWISE = [
    "License",
    "Copyright",
    "License agreement",
    "License plate",
    "License key",
    "Driver's license",
    "Fishing license",
    "License number",
    "Copyright notice",
    "Permission denied",
    "Apache helicopter",
    "Apache tribe",
    "GNU antelope",
    "Business license",
    "Marriage license",
    "License: see below",
    "License: none",
]
#: Subjects that share words with licenses, and frames that use them otherwise; every other one is held out for calibration.
SUBJECTS = (
    "license",
    "copyright",
    "permission",
    "apache",
    "gnu",
    "redistribution",
    "public domain",
    "mozilla",
    "warranty",
    "driver's license",
    "open source software",
    "creative commons room",
    "rights of tenants",
    "terms and conditions",
    "bsd course",
    "version 2.0",
)
FRAMES = (
    "The {} office opened at nine on Monday.",
    "She wrote a long paper about the {} in the library.",
    "Nobody at the meeting asked for a {} this year.",
    "The story of the {} was told under the old bridge.",
    "He lost his {} on the way to the general store.",
    "Questions about {} are answered in the second chapter.",
    "The committee reserved a table and talked about {}.",
    "They compared the {} with the one from the northern province.",
    "Without a {} the harbour may not be used after dark.",
    "A new {} was distributed free of charge at the fair.",
    "The minister defended the {} in a speech.",
    "It is said that {} changed the law of the land.",
)
TOKEN = r"[\p{L}\p{N}]+"
VARIANTS, SIMILAR, LEAST = 8, 0.6, 8
#: No words are left out of statements this short.
WHOLE = 6
ARTICLES = ("a", "an", "the")
#: Words that are the last to tell a statement from other text.
COMMON = set("and any are by can either for from in is it may names not of on or other out see should so such that this to under "
             "unless use whether with without you".split())  # fmt: skip


def _marks(similar: float = SIMILAR) -> str:
    """A pattern that every unit meets which is ``similar`` to some statement.

    Such a unit has some number of a statement's trigrams at least, so words are taken until fewer than that number of its
    trigrams hold none of them. Longer words and names go first; the commonest words of the language, and words with a k,
    which has a letter of its own as lower case elsewhere, are not needed.
    """
    open_, out = [], set()
    for text in (t for texts in (*STATEMENTS.values(), *SHORT.values()) for t in texts):
        words = [w for w in re.findall(r"[^\W_]+", text.lower()) if w not in ARTICLES]
        grams = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or {tuple(words)}
        open_.append((grams, max(1, math.ceil(similar * min(LEAST, len(grams)) - 1e-9)) if similar > 0 else 1))
    while True:
        open_ = [(left, n) for grams, n in open_ if len(left := {g for g in grams if out.isdisjoint(g)}) >= n]
        if not open_:
            break
        found = Counter(w for grams, _ in open_ for g in grams for w in set(g))
        out.add(max(found, key=lambda w: (w not in COMMON, "k" not in w, min(len(w), 5) + 4 * w.startswith("licen"), found[w], w)))
    # long words stand for all that begin like them, which does no harm; short ones for themselves
    letters: dict[str, list[str]] = {}
    for w in sorted(out):
        if len(w) < 6:
            letters.setdefault(w[0], []).append(re.escape(w[1:]) + "(?![a-zA-Z])")
        elif not any(w != x and len(x) > 5 and w.startswith(x) for x in out):
            letters.setdefault(w[0], []).append(re.escape(w[1:]))
    first = "".join(sorted(letters) + [c.upper() for c in sorted(letters)])
    return rf"(?i)(?<![a-zA-Z])(?=[{first}])(?:{'|'.join(f'{c}(?:{'|'.join(rest)})' for c, rest in letters.items())})"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _grams(words: Column, n: int) -> Column:
    run = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, run).otherwise(F.array().cast("array<string>"))


def features(words: Column) -> Column:
    return F.concat(words, _grams(words, 2), _grams(words, 3))


def _trigrams(words: Column) -> Column:
    words = F.filter(words, lambda w: ~w.isin(*ARTICLES))
    return F.array_distinct(F.when(F.size(words) >= 3, _grams(words, 3)).otherwise(F.array(F.array_join(words, " "))))


def _unknown() -> list[tuple[str, bool]]:
    """Units that state no license, and whether they are held out for calibration."""
    made = [(frame.format(subject), i % 2 == 1 and j % 2 == 1) for i, frame in enumerate(FRAMES) for j, subject in enumerate(SUBJECTS) if i % 2 == j % 2]
    return [(t, k % 4 == 3) for k, t in enumerate([*OTHERWISE, *SHORT_OTHERWISE])] + made


def _statements(spark: SparkSession) -> DataFrame:
    unknown = [text for text, held in _unknown() if not held]
    rows = [(family, i, text) for family, texts in {**{f: [*t, *SHORT[f]] for f, t in STATEMENTS.items()}, UNKNOWN: unknown}.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(
        rows, "family string, number int, text string"
    ).withColumn("words", tokens(F.col("text")))


def _variants(rows: DataFrame) -> DataFrame:
    """Each unit as it is and with other words left out; short ones are never shortened."""
    drop = lambda x, i: (F.col("variant") > 0) & (F.size("words") >= WHOLE) & (
        F.pmod(F.xxhash64("family", "number", "variant", i), F.lit(9)) == 0
    )
    out = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    return out.withColumn(
        "words", F.filter("words", lambda x, i: ~drop(x, i))
    ).withColumn("grams", features(F.col("words")))


def held_frames(spark: SparkSession) -> DataFrame:
    """Unknown units for calibration: every other frame and subject, none of which the classifier is trained on."""
    rows = [(UNKNOWN, i, text) for i, (text, held) in enumerate(_unknown()) if held]
    return spark.createDataFrame(
        rows, "family string, number int, text string"
    ).withColumn("words", tokens(F.col("text")))


def train(spark: SparkSession) -> tuple[PipelineModel, list[str], float]:
    """The classifier, its families in order, and the calibrated level of probability.

    Trained on variants of the statements and of the unknown units that are not held out; the tables are the module's own,
    so the fit has the same few thousand rows on any corpus. The level is the 99th percentile of the best family's
    probability among held-out unknown units, whose frames and subjects the classifier has not seen.
    """
    families = sorted(STATEMENTS) + [UNKNOWN]
    label = F.element_at(
        F.create_map(*[F.lit(x) for k, f in enumerate(families) for x in (f, float(k))]), F.col("family")
    )
    rows = _variants(_statements(spark)).select(
        "variant", "grams", label.alias("label"), F.when(F.col("family") == UNKNOWN, 1.0).otherwise(1.5).alias("weight")
    ).cache()
    vocabulary = sorted(r[0] for r in rows.where("variant = 0").select(F.explode("grams")).distinct().collect())
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    counted.setBinary(True)
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        family="multinomial",
        regParam=0.002,
        elasticNetParam=0.5,
        maxIter=60,
    )
    fitted = regression.fit(counted.transform(rows.coalesce(2)))
    model = PipelineModel([counted, fitted])
    best = F.array_max(F.slice(vector_to_array("probability"), 1, len(families) - 1))
    level = model.transform(_variants(held_frames(spark))).agg(F.percentile(best, F.lit(0.99))).first()[0]
    rows.unpersist()
    return model, families, max(0.5, level)


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR, filtered: bool = True
) -> DataFrame:
    """``(doc_id, paragraph, sentence, family, probability, similarity)`` of each license statement.

    Paragraphs are lines, numbered from 0, and are judged sentence by sentence. ``similarity`` is the number of trigrams
    that the sentence and the nearest statement of its family have in common, over those of the shorter, or over eight where
    the statement has as many: a few words of a long statement confirm nothing. Below ``similar`` the prediction is not
    confirmed and the sentence counts as unknown. Articles don't count. ``filtered`` only spares work: a sentence that has none
    of the words that ``_marks`` derives from the statements can't be similar to one, and isn't given to the classifier. Unknown
    sentences give no row. Null and blank texts have none; long texts are read whole; rows with equal or null ids each give
    their own; of families that are equally probable the first by name is taken; an empty table gives an empty result.
    Other columns are not read.
    """
    spark = docs.sparkSession
    model, families, level = train(spark)
    words = _marks(similar)
    has = (lambda c: F.col(c).rlike(words)) if filtered else (lambda c: F.col(c).isNotNull())
    lines = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    ).where(has("text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    units = lines.where(has("line")).select(
        "doc_id", "paragraph", F.posexplode(F.split("line", r"(?<=[.;!?])\s+(?=\p{Lu})")).alias("sentence", "unit")
    ).where(has("unit"))
    judged = model.transform(
        units.select(
            "doc_id", "paragraph", "sentence", tokens(F.col("unit")).alias("words")
        ).withColumn("grams", features(F.col("words")))
    ).withColumn("p", vector_to_array("probability"))
    names = F.array(*[F.lit(f) for f in families])
    found = judged.select(
        "doc_id",
        "paragraph",
        "sentence",
        F.get(names, F.col("prediction").cast("int")).alias("family"),
        F.array_max("p").alias("probability"),
        _trigrams(F.col("words")).alias("t"),
    ).where((F.col("family") != UNKNOWN) & (F.col("probability") >= level))
    known = _statements(spark).where(F.col("family") != UNKNOWN).groupBy("family").agg(
        F.collect_list(_trigrams(F.col("words"))).alias("known")
    )
    over = lambda k: F.greatest(F.least(F.size("t"), F.size(k)), F.least(F.lit(LEAST), F.size(k)))
    near = F.array_max(F.transform("known", lambda k: F.size(F.array_intersect("t", k)) / over(k)))
    # one row for each family
    return found.join(F.broadcast(known), "family").withColumn("similarity", near).where(
        F.col("similarity") >= similar
    ).select(
        "doc_id",
        F.col("paragraph").cast("long").alias("paragraph"),
        F.col("sentence").cast("long").alias("sentence"),
        "family",
        F.round("probability", 4).alias("probability"),
        F.round("similarity", 4).alias("similarity"),
    )
