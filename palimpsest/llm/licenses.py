"""License scans by diagonal voting, with DataFrame operations only.

1. One pass over the texts counts words and keeps of each text its k-gram hashes that occur in
   license templates, with their positions. A text that has enough of some template's k-grams, wherever they stand, is
   kept whole; no other can have a span.
2. They are joined to the positions they have in templates. Hits of one text and template vote for
   their diagonal (position in the text minus position in the template). Neighbouring diagonals are merged as far as the
   template's allowed edits reach and no further, so a merged span is never longer than its template and those edits.
3. Spans with enough distinct template positions are verified: the words of the text at that place
   are compared with the template's by edit distance. Spans that overlap one with fewer edits are dropped, so
   that "cc by nc 4 0" isn't also "cc by 4 0" with a word more.

A template of n words may differ in n // EDIT_EVERY words, short ones in none, and never in its numbers: another version is another license. Phrases of the base contract are templates too,
always without edits; every place of theirs counts, and none is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, written
from .words import gram_hashes, hashed, keyed, word_hashes, words

K, EDIT_EVERY = 2, 8

#: Fixed values of the base contract: phrase and label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: The method's own templates: usual short notices and first lines of licenses, and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "proprietary"),
]


def coded(ws: Column, letters: Column) -> Column:
    """Words as a text of one letter each: a template's words have their own letters (a map), all others a blank. So the edit distance of such texts counts words."""
    return F.array_join(F.transform(ws, lambda w: F.coalesce(F.try_element_at(letters, w), F.lit(" "))), "")


def license_scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: list[tuple[str, str]] = BASE, k: int = K, edit_every: int = EDIT_EVERY) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    n_base counts all places of base phrases, overlapping ones too; first_word and last_word
    are the smallest and largest start. labels are base_labels and the labels of verified
    template spans. score is the largest share of a template's words that a span has without edits, 1 for a base
    phrase, 0 without either. Null and empty texts have no words; repeated rows get equal rows; a null id stays null.
    Templates are parameters, not data: their k-grams are a few thousand rows at most and are broadcast.
    """
    spark = documents.sparkSession
    prepare(spark)
    if any(len(t.split()) < k for t, _ in [*base, *templates]):
        raise ValueError(f"templates need at least {k} words")
    rows_ = []
    for i, (phrase, label) in enumerate([*base, *templates]):
        ws = phrase.split()
        letters = {w: chr(0x4E00 + n) for n, w in enumerate(dict.fromkeys(ws))}
        rows_.append((i, phrase, label, i < len(base), len(ws), 0 if i < len(base) else len(ws) // edit_every, letters, "".join(letters[w] for w in ws), [w for w in ws if w.isdigit()]))
    listed = spark.createDataFrame(rows_, "t int, phrase string, label string, base boolean, n int, edits int, letters map<string,string>, code string, numbers array<string>")
    grams = hashed(listed, "t", text="phrase").select("t", F.posexplode(gram_hashes(F.col("h"), k)).alias("at", "g"))
    of = [[] for _ in rows_]  # grams of each template, of the parameters
    for g in grams.collect():
        of[g.t].append(g.g)
    known = sorted({g for gs in of for g in gs})
    needed = [max(1, row[4] - (k - 1) - k * row[5]) for row in rows_]
    # 1. one pass over all texts
    one = keyed(documents).select("k", "doc_id", "text", word_hashes(words(F.col("text"))).alias("h")).select("k", "doc_id", "text", F.size("h").alias("n_words"), gram_hashes(F.col("h"), k).alias("grams"))
    placed = F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("pos"), g.alias("g"))), lambda x: x["g"].isin(known))
    enough = F.lit(False)
    for gs, need in zip(of, needed):
        enough = enough | (F.size(F.filter(F.array(*map(F.lit, gs)), lambda g: F.array_contains("met", g))) >= need)
    one = one.select("k", "doc_id", "text", "n_words", placed.alias("hits")).withColumn("met", F.array_distinct(F.col("hits.g")))
    seen = written(one.select("k", "doc_id", "n_words", "hits", F.when((F.size("met") > 0) & enough, F.col("text")).alias("text")), "scanned")
    # 2. votes; repeated rows vote once
    hits = seen.where(F.size("hits") > 0).dropDuplicates(["k"]).select("k", F.explode("hits").alias("x")).join(F.broadcast(grams), F.col("x.g") == F.col("g")).select("k", "t", (F.col("x.pos") - F.col("at")).alias("d"), "at")
    votes = hits.groupBy("k", "t", "d").agg(F.collect_set("at").alias("at")).join(F.broadcast(listed), "t")
    by = Window.partitionBy("k", "t").orderBy("d")
    most = max((r[5] for r in rows_), default=0)
    near = F.collect_list(F.struct("d", "at")).over(by.rangeBetween(0, most))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.filter(near, lambda x: x["d"] <= F.col("d") + F.col("edits")), lambda x: x["at"]))))
    spans = votes.withColumn("covered", covered).where(F.col("covered") >= F.greatest(F.lit(1), F.col("n") - (k - 1) - k * F.col("edits"))).select("k", "t", "d")
    spans = written(spans, "spans")
    # 3. the words themselves; only texts that may have spans are read as words again, and only those are shuffled
    texts = seen.where(F.col("text").isNotNull()).select("k", "text").dropDuplicates(["k"]).join(spans.select("k").distinct(), "k", "left_semi").select("k", words(F.col("text")).alias("ws"))
    cut = F.least("d", F.lit(0))  # words of a template that stand before the text
    begin = F.greatest("d", F.lit(0))
    window = spans.join(texts, "k").join(F.broadcast(listed), "t").select("k", "t", "label", "base", "n", "edits", "code", "numbers", "letters", "d", begin.alias("start"), F.slice("ws", begin + 1, F.greatest(F.lit(0), F.col("n") + F.col("edits") + cut)).alias("piece"))
    window = window.withColumn("there", coded(F.col("piece"), F.col("letters")))
    same_numbers = lambda m: F.filter(F.slice("piece", F.lit(1), m + cut), lambda w: w.rlike("^[0-9]+$")) == F.col("numbers")
    lengths = F.filter(F.filter(F.sequence(F.col("n") - F.col("edits"), F.col("n") + F.col("edits")), lambda m: m + cut > 0), same_numbers)
    tries = F.transform(lengths, lambda m: F.struct(F.levenshtein(F.substring(F.col("there"), F.lit(1), m + cut), F.col("code")).alias("edits"), F.abs(m - F.col("n")).alias("off"), m.alias("m")))
    sure = window.withColumn("best", F.array_min(tries)).where(F.col("best.edits") <= F.col("edits"))
    sure = sure.select("k", "label", "base", "start", (F.col("start") + F.col("best.m")).alias("end"), (1 - F.col("best.edits") / F.col("n")).alias("score"))
    reach = max((r[4] + r[5] for r in rows_), default=1)
    around = F.collect_list(F.when(~F.col("base"), F.struct("start", "end", "score"))).over(Window.partitionBy("k").orderBy("start").rangeBetween(-reach, reach))
    beaten = F.exists(around, lambda x: (x["start"] < F.col("end")) & (F.col("start") < x["end"]) & (x["score"] > F.col("score")))
    sure = sure.withColumn("beaten", beaten & ~F.col("base")).where("not beaten")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    of_doc = sure.groupBy("k").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    out = seen.select("k", "doc_id", F.greatest(F.col("n_words"), F.lit(0)).cast("long").alias("n_words")).join(of_doc, "k", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
