"""License scans by diagonal voting, in DataFrame operations only.

The hashes of all rolling word k-grams of all texts are joined to the places of the k-grams in the templates: K words,
and 2 or 3 for base phrases, which have no more. Each match votes for a diagonal: place in the text less place in
the template. Votes are summed by text, template and diagonal, diagonals that differ by a few words are merged, and
a span is a license if enough of its template's grams stand in it. The words themselves are compared, not only hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from veldoc.llm.common import stored, text_key, words

#: Words of a gram, fewer in templates that are shorter.
K = 4
#: Words by which neighbouring diagonals may differ, and the share of a template's grams that its span must hold.
SLACK, SHARE = 4, 0.6

#: Phrases and labels of the base places.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening or telling passages of public licenses, and labels.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "cc-license": "licensed under a creative commons attribution",
    "cc0": "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    "copyright-notice": "copyright c all rights reserved",
}
_OUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def gram_sizes() -> list[int]:
    return sorted({min(K, t.count(" ") + 1) for t in (*BASE, *TEMPLATES.values())})


def _places(spark: SparkSession) -> DataFrame:
    """Each place of each template: the hash of its words up to K, these words, whether it is a base phrase. The templates
    are those above, so this table is of a fixed size (some hundred rows) and may be broadcast."""
    rows = []
    for base, source in ((True, BASE.items()), (False, ((t, n) for n, t in TEMPLATES.items()))):
        for text, label in source:
            w = text.split(" ")
            k = min(K, len(w))
            rows += [(text, label, base, i, len(w) - k + 1, w[i : i + k]) for i in range(len(w) - k + 1)]
    places = spark.createDataFrame(rows, "template string, label string, base boolean, at int, grams int, gram array<string>")
    return places.withColumn("hash", F.xxhash64("gram"))


def license_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, template, label, base, diag, first, last, votes): diagonals with the first and last place in the text."""
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), words(F.col(text_col)).alias("words"))
    hashes = [F.xxhash64(F.slice("words", F.col("pos") + 1, k)) for k in gram_sizes()]
    grams = texts.where(F.size("words") > 1).select("id", "key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 2)).alias("pos"))
    grams = grams.select("id", "key", "words", "pos", F.explode(F.array(*hashes)).alias("hash"))
    places = F.broadcast(_places(docs.sparkSession))
    same = (grams["hash"] == places["hash"]) & (F.slice(grams["words"], grams["pos"] + 1, F.size(places["gram"])) == places["gram"])
    votes = grams.join(places, same).groupBy("id", "key", "template", "label", "base", "grams", (F.col("pos") - F.col("at")).alias("diag"))
    return votes.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("at"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, each row once, with n_words, n_base (places of base phrases), first_word and last_word of these,
    base_labels and labels (distinct, sorted, joined by commas), score (the largest share of a template that was found;
    1 for a base phrase, 0 for nothing) and spans (label, first word, word after the last, share).

    Null and empty texts have no words, no places and empty labels. Rows that are repeated, or share an id, are each
    judged by their own text. Columns of `docs` named like the results are replaced; other names may be any.
    """
    votes = stored(license_votes(docs, id_col, text_col), "votes")  # few rows; they are used twice
    base = votes.where("base").select("id", "key", F.col("diag").alias("start"), "label", F.col("template"))
    phrase_words = F.size(F.split("template", " "))
    base = base.select("id", "key", "start", "label", (F.col("start") + phrase_words).alias("end"), F.lit(1.0).alias("share"), F.lit(True).alias("base"))

    own = votes.where(~F.col("base"))
    order = W.partitionBy("id", "key", "template").orderBy("diag", "first")
    far = F.coalesce(F.col("diag") - F.lag("diag").over(order) > SLACK, F.lit(True))
    merged = own.withColumn("new", far.cast("int")).withColumn("group", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = merged.groupBy("id", "key", "template", "label", "grams", "group").agg(F.min("first").alias("start"), (F.max("last") + K).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("held"))
    merged = merged.withColumn("share", F.col("held") / F.col("grams")).where(F.col("share") >= SHARE)
    merged = merged.select("id", "key", "start", "label", "end", "share", F.lit(False).alias("base"))

    places = base.union(merged)
    only = lambda c: F.when(F.col("base"), F.col(c))
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    found = places.groupBy("id", "key").agg(
        F.count(only("start")).alias("n_base"),
        F.min(only("start")).cast("long").alias("first_word"),
        F.max(only("start")).cast("long").alias("last_word"),
        joined(only("label")).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "share"))).alias("spans"),
    )
    kept = [c for c in docs.columns if c not in _OUT]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(id_col).alias("own_id"), text_key(F.col(text_col)).alias("own_key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    rows = rows.join(found, rows["own_id"].eqNullSafe(found["id"]) & (rows["own_key"] == found["key"]), "left")
    none = F.array().cast("array<struct<start:int,end:int,label:string,share:double>>")
    return rows.select("row.*", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", none).alias("spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and labels, for each row of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
