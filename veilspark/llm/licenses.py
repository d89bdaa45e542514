"""License scans by diagonal voting, in DataFrame operations only.

Every template is a fixed word sequence. All rolling k-word grams of the documents are joined to
the template positions with the same gram; a hit at word p for template position t votes for the
diagonal p - t. Votes are counted per document, template and diagonal. Diagonals of one template
that lie next to each other (an inserted or dropped word shifts the rest) are merged, and the span
they cover is verified: a phrase by its words, one by one; a longer text by its share of grams.

The templates are the constants below, so the broadcast side has a fixed size. Grams come from a
generator inside one whole-stage block and only hits leave it.

Defined results: null text counts as empty and has no words; texts shorter than a phrase have no
hits; equal rows get equal results each; extra columns are ignored; an empty table gives no rows; a
null doc_id is carried as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: phrases that count as base places, with their labels
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# fixed values: longer wordings, with their labels
TEXTS = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
K = 2
#: Share of a text's grams that a merged span must hold, and how far diagonals may lie apart.
SHARE, NEAR = 0.6, 2
OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
h AS (
  SELECT doc_id, i,
    CASE WHEN w[i+1] = 'gnu' AND w[i+2] = 'general' AND w[i+3] = 'public' AND w[i+4] = 'license' THEN 'gpl'
         WHEN w[i+1] = 'apache' AND w[i+2] = 'license' THEN 'apache'
         WHEN w[i+1] = 'cc' AND w[i+2] = 'by' THEN 'cc-by'
         WHEN w[i+1] = 'mit' AND w[i+2] = 'license' THEN 'mit' END AS label FROM p),
b AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM h WHERE label IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word, coalesce(b.ls, '') AS base_labels
FROM d LEFT JOIN b USING (doc_id)
"""


def _templates(spark) -> DataFrame:
    rows = []
    for base, group in ((True, PHRASES), (False, TEXTS)):
        for text, label in group.items():
            w = text.split(" ")
            for t in range(len(w) - K + 1):
                rows.append((text, label, base, t, len(w) - K + 1, w[t], w[t + 1]))
    return spark.createDataFrame(rows, "template string, label string, base boolean, t int, grams int, a string, b string")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches of each document.

    score is the largest share of grams that any verified span holds; matches lists the spans
    (label, first word, end word, share).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    # lower() changes letters beyond ASCII too, which moves no word's ends and matches no template
    words = F.split(F.lower(text), OUTSIDE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("dig"), words.alias("w"))
    # a text that starts or ends with other bytes gives an empty string there
    lead = (F.col("w")[0] == "").cast("int")
    keyed = rows.select("doc_id", "dig", (F.size("w") - F.when(F.size("w") > 1, lead + (F.element_at("w", -1) == "").cast("int")).otherwise(lead)).cast("long").alias("n_words"))

    # the outer form, so that the split isn't run again for a filter below the generator
    at = rows.select("doc_id", "dig", "w", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("w") - K, F.lit(0)))).alias("p"))
    grams = at.withColumn("g", F.xxhash64(F.get("w", F.col("p")), F.get("w", F.col("p") + 1)))
    places = _templates(spark).withColumn("g", F.xxhash64("a", "b"))
    hits = grams.join(F.broadcast(places), "g")  # the constants above: a fixed size
    # the words themselves are compared, not only their hash
    hits = hits.filter((F.get("w", F.col("p")) == F.col("a")) & (F.get("w", F.col("p") + 1) == F.col("b")))
    # places count words from 0
    hits = hits.select("doc_id", "dig", "template", "label", "base", "grams", "t", (F.col("p") - F.col("t") - lead).alias("diagonal"))

    # votes of a template position count once, so equal rows don't add up
    key = ["doc_id", "dig", "template", "label", "base", "grams"]
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_set("t").alias("ts"))
    phrases = votes.filter(F.col("base") & (F.size("ts") == F.col("grams")))
    found = phrases.select("doc_id", "dig", "label", F.lit(True).alias("base"), F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("grams") + 1).cast("long").alias("end"), F.lit(1.0).alias("share"))

    # neighbouring diagonals of a text: chains with gaps of NEAR words at most are one place
    by = W.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > NEAR, F.lit(True)).cast("int")
    chained = votes.filter(~F.col("base")).withColumn("new", apart).withColumn("chain", F.sum("new").over(by))
    # a template has no more positions than its words
    merged = chained.select(*key, "chain", "diagonal", F.explode("ts").alias("t")).groupBy(*key, "chain").agg(F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.collect_set("t").alias("ts"))
    share = F.size("ts") / F.col("grams")
    start, end = F.col("first") + F.array_min("ts"), F.col("last") + F.array_max("ts") + K
    texts = merged.filter(share >= SHARE).select("doc_id", "dig", "label", F.lit(False).alias("base"), start.cast("long").alias("start"), end.cast("long").alias("end"), share.alias("share"))

    per = found.unionByName(texts).groupBy("doc_id", "dig").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "share"))).alias("matches"),
    )
    per = per.withColumnsRenamed({"doc_id": "p_id", "dig": "p_dig"})
    out = keyed.join(per, (F.col("dig") == F.col("p_dig")) & F.col("doc_id").eqNullSafe(F.col("p_id")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("matches", F.expr("cast(array() as array<struct<start:bigint,end:bigint,label:string,share:double>>)")).alias("matches"),
    )
