"""License scans by diagonal voting, with DataFrame functions alone.

Every rolling k-gram of a text's words (GRAM words for templates, PAIR for
phrases) is joined by hash to the same k-grams of the templates. A hit votes
for its diagonal, the text position minus the template position; diagonals at
most DRIFT apart (words put in or left out) are merged, and a span counts if
the template's words that its votes cover, each once, are enough of the
template.
Phrases are templates that must be covered whole, on one diagonal; hits are
compared word by word, so a hash collision can't add any.

Null and empty texts have no words and no labels. Rows with the same doc_id
and text are one document: each gets its result. Columns other than doc_id
and text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.storage import staged

#: Phrases and passages that name a license, in lower case, words alone.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement "
        "of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
        "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
        "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it "
        "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "general public license for more details you should have received a copy of the gnu general public license along with this program",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)

#: Words a k-gram: of phrases, and of templates.
PAIR, GRAM = 2, 4
DRIFT = 3
#: Share of a template's words that must be covered: short templates (under SHORT words), long ones.
COVER_SHORT, COVER_LONG, SHORT = 0.9, 0.6, 9
#: A span may be this many times as long as its template.
STRETCH = 1.5

_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A text's words, A-Z in lower case; ASCII texts take the quicker of two equal ways."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _APART), "")


def template_grams() -> list[tuple]:
    """template, label, phrase, size (words), k, tpos, gram: one for each k-gram of each template."""
    out = []
    for i, (label, text) in enumerate(PHRASES + TEMPLATES):
        own, phrase = text.split(), i < len(PHRASES)
        k = PAIR if phrase else GRAM
        out += [(i, label, phrase, len(own), k, at, " ".join(own[at : at + k])) for at in range(len(own) - k + 1)]
    return out


def template_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({i}, '{label}', {str(phrase).lower()}, {size}, {k}, {at}, '{gram}')" for i, label, phrase, size, k, at, gram in template_grams())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, phrase, size, k, tpos, t)").withColumn("h", F.xxhash64("t"))


def hits(docs: DataFrame) -> DataFrame:
    """A row for every hit of a k-gram, and one for the first word of every document whether it hits or not."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tx"), words(F.col("text")).alias("w")
    )
    size = F.size("w")
    later = [F.slice("w", at + 1, F.greatest(size, F.lit(1))).alias(f"w{at}") for at in range(1, GRAM)]
    base = base.select("doc_id", "tx", size.cast("long").alias("n_words"), F.arrays_zip("w", *later).alias("p"))
    rolled = base.select("doc_id", "tx", "n_words", F.posexplode_outer("p").alias("pos", "g"))
    full = F.col(f"g.w{GRAM - 1}").isNotNull()  # a text's last words begin no k-gram
    pair, gram = F.concat_ws(" ", "g.w", "g.w1"), F.when(full, F.concat_ws(" ", "g.w", *[f"g.w{at}" for at in range(1, GRAM)]))
    rolled = rolled.select("doc_id", "tx", "n_words", "pos", F.posexplode(F.array(pair, gram)).alias("longer", "x")).withColumn("h", F.xxhash64("x"))
    known = F.broadcast(template_table(docs.sparkSession))  # a fixed list, some thousand rows
    found = rolled.join(known, (rolled["h"] == known["h"]) & (rolled["x"] == known["t"]), "left")
    found = found.where("template is not null or (longer = 0 and coalesce(pos, 0) = 0)")
    return found.select("doc_id", "tx", "n_words", "pos", "template", "label", "phrase", "size", "k", "tpos")


def spans(found: DataFrame) -> DataFrame:
    """doc_id, tx, label, phrase, first (word), last (word), cover of every verified span."""
    key = ["doc_id", "tx", "template", "label", "phrase", "size", "k"]
    votes = found.where("template is not null").select(*key, "tpos", "pos").distinct()
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("tpos"))
    bounds = F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k") - 1).alias("last")
    whole = votes.where("phrase").groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), *bounds)
    whole = whole.where("votes = size - k + 1").withColumn("cover", F.lit(1.0))
    w = Window.partitionBy("doc_id", "tx", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT).cast("int"), F.lit(0))
    merged = (
        votes.where("not phrase").withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("own", F.explode(F.sequence("tpos", F.col("tpos") + F.col("k") - 1)))
        .groupBy(*key, "run").agg(F.count_distinct("own").alias("held"), *bounds)
        .withColumn("cover", F.col("held") / F.col("size"))
    )
    enough = F.col("cover") >= F.when(F.col("size") < SHORT, COVER_SHORT).otherwise(COVER_LONG)
    fits = F.col("last") - F.col("first") <= STRETCH * F.col("size")
    out = ["doc_id", "tx", "label", "phrase", "first", "last", "cover"]
    return whole.select(*out).unionByName(merged.where(enough & fits).select(*out))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = staged(hits(docs), "hits")
    per = spans(found).groupBy("doc_id", "tx").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    # the first word may hit several templates: one row of them stands for the document
    rows = found.where("coalesce(pos, 0) = 0")
    least = rows.groupBy("doc_id", "tx").agg(F.min(F.struct("template", "tpos")).alias("one"))
    rows = rows.alias("r").join(least.alias("l"), F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("r.tx").eqNullSafe(F.col("l.tx")))
    rows = rows.where(F.struct("r.template", "r.tpos").eqNullSafe(F.col("l.one"))).select("r.doc_id", "r.tx", "r.n_words").alias("r")
    joined = rows.join(per.alias("p"), F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("r.tx").eqNullSafe(F.col("p.tx")), "left")
    return joined.select(
        "r.doc_id", "r.n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
