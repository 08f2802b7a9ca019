"""Licence scans by diagonal voting: every rolling group of k words of a document that a template holds is a vote for the
diagonal (place in the document minus place in the template); votes are counted per diagonal, neighbouring diagonals
are merged (a word put in or left out shifts the rest by one) unless one of them covers the template alone, and a span is kept once its words cover
the template.

k is 3, and 2 for the base phrases, of which two have no more words. Templates are the clauses of whole licences: each is found on its own, so a text that
quotes one clause is labelled, and one that holds them all gets one label. Clauses that several licences share have a label of their own (``as-is``).
A clause of many words may be edited more than a name.

The templates are some thousand groups of words, a parameter and not data, so they are broadcast and documents stay where they are; only
votes, a few rows for a document that has licence wording, are shuffled, by document. Groups are joined by hash and compared as text.

Defined results: null and empty texts have no words and no labels; repeated rows get equal results (votes are counted once per
distinct doc_id and text); ties between merged spans go to the smaller diagonal; very long texts are one row until their words
are joined; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, columns_of, let, materialize

#: What separates words (fixed by the contract).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The contract's phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Clauses, notices and names of licences, with labels (fixed values; pass your own for more).
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "as-is"),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "as-is"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache"),
    ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("the gnu general public license is a free copyleft license for software and other kinds of works", "gpl"),
    ("the licenses for most software and other practical works are designed to take away your freedom to share and change the works", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("cc0 1 0 universal", "cc0"),
    ("mozilla public license", "mpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd"),
    ("in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
    ("boost software license version 1 0", "boost"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", "boost"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "zlib"),
    ("eclipse public license", "epl"),
)
#: Words too common for a group of them alone to tell anything.
COMMON = frozenset("a and any by for in is it of or the this to under with without you".split())
K, BASE_K = 3, 2
#: Share of a template's groups that a span has to hold: of a name or short notice, and of a clause with LONG groups or more. A changed word takes K groups, so that many bear two.
COVER, COVER_LONG, LONG = 0.75, 0.6, 15
SHIFT = 3


def template_groups(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """tid, tpos, words (of a group), need (groups of the template), label, base, cover."""
    rows = []
    for tid, (text, label, base) in enumerate([(*b, True) for b in BASE] + [(*t, False) for t in templates]):
        words, k = re.split(SEPARATORS, text), BASE_K if base else K
        groups = [(i, words[i : i + k]) for i in range(len(words) - k + 1)]
        kept = [(i, " ".join(g)) for i, g in groups if base or not COMMON.issuperset(g)]
        rows += [(tid, i, g, len(kept), label, base, 1.0 if base else COVER_LONG if len(kept) >= LONG else COVER) for i, g in kept]
    return spark.createDataFrame(rows, "tid int, tpos int, words string, need int, label string, base boolean, cover double").withColumn("h", F.xxhash64("words"))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _groups(w: Column) -> Column:
    """(pos, p) of all groups of K words, and of those pairs that a base phrase has."""
    base_pairs = sorted({" ".join(g) for phrase, _ in BASE for g in zip(phrase.split(), phrase.split()[1:])})
    ends = sorted({p.split()[1] for p in base_pairs})
    beside = lambda a, b: F.concat(a, F.lit(" "), b)
    pairs = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*ends) & (i > 0), F.struct((i - 1).alias("pos"), beside(F.get(w, i - 1), x).alias("p")))), lambda s: s["p"].isin(*base_pairs))
    long = F.zip_with(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), beside), F.slice(w, F.lit(3), F.size(w)), beside)  # null at the end, where words are missing
    return F.concat(F.transform(long, lambda p, i: F.struct(i.alias("pos"), p.alias("p"))), pairs)


def scan(df: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, th, n_words; spans: doc_id, th, label, base, start, end, covered). th is a hash of the text."""
    docs = columns_of(df, doc_id="long", text="string")
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), _words(F.col("text")).alias("w"))
    groups = docs.where(F.size("w") > 1).select("doc_id", "th", F.inline(_groups(F.col("w")))).withColumn("h", F.xxhash64("p"))
    table = F.broadcast(template_groups(df.sparkSession, templates))  # some thousand rows of parameters
    votes = groups.join(table, "h").where(F.col("p") == F.col("words"))
    votes = votes.select("doc_id", "th", "tid", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"), "need", "label", "base", "cover").distinct()
    diagonals = votes.groupBy("doc_id", "th", "tid", "diagonal", "need", "label", "base", "cover").agg(F.collect_set("tpos").alias("at"))  # a template's length at most
    order = Window.partitionBy("doc_id", "th", "tid").orderBy("diagonal")
    around, ahead = order.rangeBetween(-SHIFT, SHIFT), order.rangeBetween(0, SHIFT)
    one = diagonals.withColumns({
        "own": F.size("at") / F.col("need"), "start": F.col("diagonal") + F.array_min("at"), "end": F.col("diagonal") + F.array_max("at") + F.when(F.col("base"), BASE_K).otherwise(K),
    })
    seen = one.withColumns({
        "whole_near": F.max(F.col("own") >= F.col("cover")).over(around), "merged": F.size(F.array_distinct(F.flatten(F.collect_list("at").over(ahead)))) / F.col("need"),  # 2 * SHIFT diagonals at most
        "merged_start": F.min("start").over(ahead), "merged_end": F.max("end").over(ahead),
    })
    best = F.max(F.struct("merged", -F.col("diagonal"))).over(around) == F.struct("merged", -F.col("diagonal"))
    seen = seen.withColumn("best", best)
    # the base phrases stand word for word; a diagonal that covers enough is a span itself, others are merged with the neighbours ahead, best ones first
    alone = F.when(F.col("base"), F.col("own") == 1).otherwise(F.col("own") >= F.col("cover"))
    joined = ~F.col("base") & ~F.col("whole_near") & F.col("best") & (F.col("merged") >= F.col("cover"))
    pick = lambda a, b: F.when(alone, F.col(a)).otherwise(F.col(b)).alias(a)
    kept = seen.where(alone | joined).select("doc_id", "th", "label", "base", pick("start", "merged_start"), pick("end", "merged_end"), F.when(alone, F.col("own")).otherwise(F.col("merged")).alias("covered"))
    return docs.select("doc_id", "th", F.size("w").cast("long").alias("n_words")), kept.select("doc_id", "th", "label", "base", "start", "end", "covered")


def op6(df: DataFrame) -> DataFrame:
    docs, spans = scan(df)
    spans = materialize(spans)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("base")
    per = spans.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.max("covered").cast("double").alias("score"),
    )
    out = docs.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("th").eqNullSafe(F.col("_th")), "left")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("doc_id", "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))
