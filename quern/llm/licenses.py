"""License scans by diagonal voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.words import grams, words

K = 3  # words in a gram
GAP = 2  # diagonals this near belong to one span: a word more or less in the copy
LEAST_SHARE = 0.7  # words of a span that must be the template's
# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices and opening terms of public licenses, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def template_grams(spark: SparkSession) -> DataFrame:
    """(h, template, label, size, place, gram): each K-gram of the fixed templates; their number is a constant of this module."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.split(F.lit(b), " ").alias("t")) for i, (a, b) in enumerate(TEMPLATES)])
    one = spark.range(1).select(F.inline(rows))
    return one.select("template", "label", F.size("t").alias("size"), "t", F.posexplode(grams(F.col("t"), tuple(range(K)))).alias("place", "h")).select(
        "h", "template", "label", "size", "place", F.slice("t", F.col("place") + 1, K).alias("gram")
    )


def votes_to_spans(hits: DataFrame, key: list[str]) -> DataFrame:
    """(key, template, label, first, last, matched, valid, share): merged diagonals, valid if verified. hits: key, template, label, size, at, place; a row without hits has nulls there and stays, not valid."""
    votes = hits.groupBy(*key, "template", "label", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi")
    )
    along = W.partitionBy(*key, "template").orderBy("diagonal")
    merged = votes.withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(GAP + 1)) > GAP).cast("int")).withColumn("run", F.sum("new").over(along))
    wide = F.col("last") - F.col("first") + 1
    return (
        merged.groupBy(*key, "template", "label", "size", "run")
        .agg(F.sum("votes").alias("votes"), F.count("*").alias("diagonals"), F.min("lo").alias("first"), (F.max("hi") + K - 1).alias("last"))
        .withColumn("matched", F.least(F.col("votes") + (K - 1) * F.col("diagonals"), wide))
        .withColumn("valid", F.coalesce(F.col("matched") >= LEAST_SHARE * F.least("size", F.greatest(wide, F.lit(16))), F.lit(False)))
        .select(*key, "template", "label", "first", "last", "matched", "valid", F.least(F.col("matched") / F.col("size"), F.lit(1.0)).alias("share"))
    )


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def with_hits(documents: DataFrame) -> DataFrame:
    """A row per document and hit (or one without): row, doc_id, n_words, part, own, template, label, size, at, place.

    Every rolling K-gram hash is computed; those that no template has are dropped in the row, before the join, by the
    bounded list of template hashes; a hit's words are compared with the template's, so that no collision counts.
    """
    known = template_grams(documents.sparkSession)
    hashes = [r.h for r in known.select("h").distinct().collect()]  # a constant of this module
    tokens = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    line = tokens.select("*", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("x"), grams(F.col("w"), tuple(range(K))).alias("g"))
    has = [F.contains("x", F.lit(f" {p} ")) for p in PHRASES]
    hits = F.transform("g", lambda h, i: F.when(h.isin(hashes), F.struct(h.alias("h"), i.alias("at"))))
    flat = line.select(
        "row", "doc_id", "w",
        F.size("w").cast("bigint").alias("n_words"),
        F.when(has[0] | has[1] | has[2] | has[3], F.split("x", f" (?=(?:{'|'.join(PHRASES)}) )", -1)).alias("part"),
        F.array_compact(F.array(*[F.when(h, F.lit(v)) for h, v in zip(has, PHRASES.values(), strict=True)])).alias("own"),
        F.explode_outer(F.filter(hits, lambda x: x.isNotNull())).alias("hit"),
    )
    at = F.col("hit.at")
    return (
        flat.withColumn("gh", F.col("hit.h"))
        .join(F.broadcast(known), (F.col("gh") == F.col("h")) & (F.slice("w", at + 1, K) == F.col("gram")), "left")
        .select("row", "doc_id", "n_words", "part", "own", "template", "label", "size", at.alias("at"), "place")
    )


def scan(documents: DataFrame) -> DataFrame:
    """License phrases and template spans of each document.

    Returns one row per row of `documents`: doc_id, n_words, n_base (places of base phrases), first_word, last_word
    (their smallest and largest start, else null), base_labels, labels (sorted, comma-joined), score (1 with a base
    phrase, else the best template's share of words found, else 0). A null or empty text has no words; repeated rows
    are each scanned; other columns are ignored.
    """
    facts = with_hits(documents).select(
        "row", "doc_id", "n_words", "own", "template", "label", "size", "at", "place",
        F.coalesce(F.size("part") - 1, F.lit(0)).cast("bigint").alias("n_base"),
        _spaces(F.get("part", F.lit(0))).cast("bigint").alias("first_word"),
        (F.col("n_words") - _spaces(F.element_at("part", -1))).cast("bigint").alias("last_word"),
    )
    row = ["doc_id", "n_words", "n_base", "first_word", "last_word", "own"]
    spans = votes_to_spans(facts, ["row", *row])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.max(F.when(F.col("valid"), F.col("share"))), F.lit(0.0))
    return (
        spans.groupBy("row", *row)
        .agg(F.collect_set(F.when(F.col("valid"), F.col("label"))).alias("more"), best.alias("best"))
        .select(
            *row[:-1],
            labels(F.col("own")).alias("base_labels"),
            labels(F.concat("own", "more")).alias("labels"),
            F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.round("best", 6)).alias("score"),
        )
    )
