"""License scans by diagonal voting, in DataFrame functions only.

Every rolling k-gram of a text's words is hashed and joined to the positions it has in the templates. Hits vote for the
diagonal (word minus template position); neighbouring diagonals are merged, and a merged span counts when enough of the
template's k-grams voted for it within a span of the template's size.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words, base phrases and their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices as their licences give them or as they are commonly written.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "this software is licensed under the terms of the mit license see license for details"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by", "this work is licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Template k-grams up to which a literal set thins the rows before the join; beyond it all are joined.
LITERALS = 20_000


def words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(w: Column, k: int) -> Column:
    """(pos, gram) of each run of k words."""
    at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("gram")))


def base_places(w: Column) -> Column:
    """(pos, label) of each place where the words of a base phrase stand."""
    at = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))

    def label(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, name in BASE:
            parts = phrase.split()
            met = F.get(w, i) == parts[0]
            for j, part in enumerate(parts[1:], 1):
                met &= F.get(w, i + j) == part
            found = F.when(met, F.lit(name)).otherwise(found)
        return found

    first = sorted({p.split()[0] for p, _ in BASE})
    starts = F.filter(at, lambda i: F.get(w, i).isin(first))
    return F.filter(F.transform(starts, lambda i: F.struct(i.alias("pos"), label(i).alias("label"))), lambda x: x["label"].isNotNull())


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = 3) -> DataFrame:
    """(template, label, tpos, total, gram) of the templates' k-grams; those under k words have none."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    rows = rows.select("template", "label", F.explode(grams(words(F.col("text")), k)).alias("g"))
    return rows.select("template", "label", F.col("g.pos").alias("tpos"), F.count("*").over(Window.partitionBy("template")).alias("total"), F.col("g.gram").alias("gram"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, k: int = 3, coverage: float = 0.6, shift: int = 3) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of docs(doc_id, text).

    score: the share of the template's k-gram places that the best verified span holds, at least 0.5 with a base phrase, else 0.
    spans: (label, first word, word after the last). Null and empty texts have no words and empty labels. Rows that
    repeat a doc_id stay apart; other columns are ignored. The templates are a fixed table, broadcast whatever the input.
    """
    spark = docs.sparkSession
    known = template_grams(spark, templates, k)
    literals = [r[0] for r in known.select("gram").distinct().limit(LITERALS + 1).collect()]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of(w: Column) -> Column:
        g = grams(w, k)
        return F.struct(F.size(w).cast("bigint").alias("n_words"), base_places(w).alias("base"), (F.filter(g, lambda x: x["gram"].isin(literals)) if len(literals) <= LITERALS else g).alias("grams"))

    # A row's base places are summed up before its k-grams are spread: hits carry a few values each, however many places there are.
    at = F.transform("t.base", lambda x: x["pos"].cast("bigint"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), let(words(text), of).alias("t"))
    rows = rows.select(
        "rid", "doc_id", "t.n_words", F.size("t.base").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("t.base", lambda x: x["label"]))).alias("own"), "t.grams",
    )
    row = ["doc_id", "n_words", "n_base", "first_word", "last_word", "own"]
    rows = rows.select("rid", *row, F.explode_outer("grams").alias("g"))
    hits = rows.join(F.broadcast(known), F.col("g.gram") == F.col("gram"), "left").repartition("rid")
    kept = [F.first(c).alias(c) for c in row]
    votes = hits.groupBy("rid", "template", "label", "total", (F.col("g.pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("places"), F.min("g.pos").alias("low"), F.max("g.pos").alias("high"), *kept)
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > shift, F.lit(True)).cast("int")
    votes = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    spans = votes.groupBy("rid", "template", "label", "total", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.min("low").alias("low"), (F.max("high") + k).alias("high"), *kept)
    # Verified: so many different places of the template stand in a span that is not much longer than the template.
    share = F.col("places") / F.col("total")
    good = F.col("template").isNotNull() & (share >= coverage) & (F.col("high") - F.col("low") <= 1.5 * (F.col("total") + k - 1) + shift)
    got = spans.groupBy("rid").agg(
        *kept, F.collect_set(F.when(good, F.col("label"))).alias("more"), F.max(F.when(good, share)).alias("best"),
        F.sort_array(F.collect_list(F.when(good, F.struct("low", "high", "label")))).alias("spans"),
    )
    return got.select(
        *row[:-1], F.array_join("own", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("own", "more")), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.transform("spans", lambda x: F.struct(x["label"].alias("label"), x["low"].cast("bigint").alias("first"), x["high"].cast("bigint").alias("end"))).alias("spans"),
    )
