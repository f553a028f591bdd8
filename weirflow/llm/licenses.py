"""License scans by diagonal voting, in built-in functions alone.

Every rolling k-gram of a text's words is hashed and joined to the positions of the templates' k-grams. A hit at word p of the
text and word q of the template votes for the diagonal p - q; votes are bits of q, so that repeats count once. Diagonals of a
template that lie at most ``drift`` words apart (words put in or left out) merge into a span, which is verified by the share of
the template's k-grams that it covers. Phrases are templates that only count where they stand whole, on one diagonal.

Grams meet by 64-bit hash of their words and of their length; a text is read once, and after the map-side aggregation a document is one row and
one more per diagonal, so a word that is everywhere costs nothing in the shuffle.

Null, empty and wordless texts have no words, no span and score 0. Rows of equal doc_id and text are aggregated together and
come back as often as they were; rows that only share a doc_id (null too) are told apart by a hash of the text. Columns beyond
doc_id and text are ignored, whatever their names. A text is worked on whole, so one row's words must fit a task's memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import bounded

#: Phrases with their labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Notices by which licenses are granted, with their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]

#: What stands between words, once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """A text's words: maximal runs of a-z, 0-9 and all beyond ASCII, with A-Z (and nothing else) lower-cased."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def _hashes(ws: str, sizes: list[int]) -> Column:
    """Hashes of all rolling grams of the array ``ws``, those of each size after the other."""

    def of(size: int) -> Column:
        gram = lambda i: F.xxhash64(F.lit(size), *[F.get(F.col(ws), i + j) for j in range(size)])
        return F.when(F.size(ws) >= size, F.transform(F.sequence(F.lit(0), F.size(ws) - size), gram)).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[of(s) for s in sizes])


def _before(n: Column, size: int, sizes: list[int]) -> Column:
    """How many hashes of ``n`` words come before those of ``size``."""
    return reduce(lambda a, s: a + F.greatest(n - F.lit(s - 1), F.lit(0)), [s for s in sizes if s < size], F.lit(0))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, k: int = 4, drift: int = 3, least: float = 0.6) -> DataFrame:
    """A row a row of ``docs`` (doc_id, text): doc_id, n_words, n_base (places of phrases), first_word and last_word (their
    first and last start, from 0), base_labels and labels (sorted arrays), spans and score.

    ``phrases`` and ``notices`` are (label, text). A template of fewer words than ``k`` goes by its grams of as many words as the
    shortest template has. spans has (label, start, end, covered), in words, of all that cover ``least`` of their template;
    labels has theirs and those of phrases; score is the largest share covered.
    """
    spark = docs.sparkSession
    split_up = spark.createDataFrame([(t, label, text, t < len(phrases)) for t, (label, text) in enumerate([*phrases, *notices])], "t int, label string, text string, whole boolean").select("t", "label", "whole", words(F.col("text")).alias("ws"))
    lengths = [r.n for r in split_up.select(F.size("ws").alias("n")).collect()]
    if not lengths or min(lengths) == 0:
        raise ValueError("templates need words")
    sizes = sorted({k} & {min(k, n) for n in lengths} | {min(lengths)} if min(lengths) < k else {k})
    size = F.when(F.size("ws") >= k, k).otherwise(min(lengths))
    of_size = reduce(lambda a, s: a.when(size == s, _hashes("ws", [s])), sizes, F.when(F.lit(False), F.array().cast("array<bigint>")))
    templates = split_up.select("t", "label", "whole", (F.size("ws") - size + 1).alias("of"))
    n_masks = (max(lengths) + 63) // 64
    grams = split_up.select("t", size.alias("size"), F.posexplode(of_size).alias("q", "key"))
    # one gram may stand at several places: only the first of them counts the text's rows
    grams = grams.withColumn("first", F.expr("row_number() over (partition by key order by t, q) = 1"))
    grams = grams.withColumns({f"m{j}": F.expr(f"if(q div 64 = {j}, shiftleft(1L, q % 64), 0L)") for j in range(n_masks)})

    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("ws")).withColumn("n", F.size("ws"))
    hashed = texts.select("doc_id", "h", "n", F.posexplode_outer(_hashes("ws", sizes)).alias("at", "key"))
    voted = hashed.join(bounded(grams, sum(lengths), 96), "key", "left")
    start = F.col("at") - reduce(lambda a, s: a.when(F.col("size") == s, _before(F.col("n"), s, sizes)), sizes, F.when(F.lit(False), 0))
    diagonals = voted.withColumn("start", start).groupBy("doc_id", "h", "n", "t", (F.col("start") - F.col("q")).alias("d")).agg(
        F.count_if((F.coalesce(F.col("at"), F.lit(0)) == 0) & F.coalesce(F.col("first"), F.lit(True))).alias("rows"),
        F.min("start").alias("lo"),
        F.max(F.col("start") + F.col("size")).alias("hi"),
        *[F.bit_or(f"m{j}").alias(f"m{j}") for j in range(n_masks)],
    )
    diagonals = diagonals.join(bounded(templates, len(lengths), 64), "t", "left")
    template = ["t", "label", "whole", "of"]
    covered = lambda of: reduce(lambda a, b: a + b, [F.bit_count(F.col(f"m{j}")) for j in range(n_masks)]).cast("double") / of
    # neighbouring diagonals: a span begins where the one before is too far away; phrases don't merge
    runs = diagonals.withColumn("apart", F.expr(f"d - lag(d) over (partition by doc_id, h, t order by d) > {int(drift)} or whole")).withColumn("span", F.expr("sum(int(coalesce(apart, true))) over (partition by doc_id, h, t order by d rows unbounded preceding)"))
    spans = runs.groupBy("doc_id", "h", "n", *template, "span").agg(F.sum("rows").alias("rows"), F.min("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.bit_or(f"m{j}").alias(f"m{j}") for j in range(n_masks)]).withColumn("covered", covered(F.col("of")))
    place = F.col("whole") & (F.col("covered") == 1)
    good = F.col("t").isNotNull() & (place | ~F.col("whole") & (F.col("covered") >= least))
    found = spans.groupBy("doc_id", "h", "n").agg(
        F.sum("rows").alias("rows"),
        F.count_if(F.coalesce(place, F.lit(False))).alias("n_base"),
        F.min(F.when(place, F.col("d"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("d"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(place, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(good, F.col("label")))).alias("labels"),
        F.array_sort(F.collect_list(F.when(good, F.struct(F.col("lo").alias("start"), F.col("hi").alias("end"), "label", "covered")))).alias("spans"),
        F.coalesce(F.max(F.when(good | ~F.col("whole"), F.col("covered"))), F.lit(0.0)).alias("score"),
    )
    return found.select("doc_id", F.col("n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("copy")).drop("copy")
