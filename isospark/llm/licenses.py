"""License scans by diagonal voting.

Templates are word sequences: short phrases (base) that count only where all
their words stand consecutively, and license texts that may differ in places.
All rolling 2-word grams of every text are joined by hash to the grams' places
in the templates (the words themselves are compared too). A gram at word d that
stands at place p of a template votes for the diagonal d - p, the word where the
template would begin. Votes are gathered by template and diagonal, diagonals at
most GAP apart are merged (inserted or missing words shift the rest of a text),
and a span is accepted if enough of the template's places voted: all for a
phrase, ACCEPT of them for a license text. It reaches from the first word that
voted to the last, so it lies within the text where parts of the template are
missing. Grams of two common words don't vote, so they fetch nothing.

All of it is DataFrame functions. The text is read once and not shuffled: what
is shuffled is one row for each text and one for each vote. The templates are a
constant of a few kilobytes and broadcast.

Defined cases: a null or wordless text has no words and no spans. Repeated rows
are scanned each; ids may be null. Input columns are chosen by name, others are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

GAP, ACCEPT = 2, 0.6

#: The contract's phrases and labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Well-known sentences of licenses, as words.
TEXTS = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("gnu affero general public license as published by the free software foundation", "agpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words that don't vote beside each other.
COMMON = frozenset("a and any are as by for in is it of on or that the this to under use with you".split())


def template_grams() -> list[tuple]:
    """(template, label, base, n_words, n_grams, place, w1, w2) of every gram that votes."""
    rows = []
    for number, (phrase, label, base) in enumerate([(p, x, True) for p, x in PHRASES] + [(p, x, False) for p, x in TEXTS]):
        words = phrase.split()
        grams = [(k, a, b) for k, (a, b) in enumerate(zip(words, words[1:])) if base or not {a, b} <= COMMON]
        rows += [(number, label, base, len(words), len(grams), k, a, b) for k, a, b in grams]
    return rows


def words_of(text: Column) -> Column:
    """The words of a text; lower() differs from A-Z alone in no word that a base phrase has."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and spans array<struct<label, base, start, stop, coverage>> (words, stop exclusive) of each row."""
    spark = docs.sparkSession
    grams = spark.createDataFrame(template_grams(), "template int, label string, base boolean, size int, n_grams int, place int, t1 string, t2 string").withColumn("gram", F.xxhash64("t1", "t2"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    rolling = texts.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, size(words))").alias("b"))).alias("at", "pair"))
    rolling = rolling.select("row", "doc_id", "n_words", "at", F.col("pair.a").alias("w1"), F.col("pair.b").alias("w2")).withColumn("hash", F.xxhash64("w1", "w2"))
    met = (F.col("hash") == F.col("gram")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    # The first row of a text stays without a vote too, and carries its number of words.
    votes = rolling.join(F.broadcast(grams), met, "left").where(F.col("template").isNotNull() | F.coalesce(F.col("at") == 0, F.lit(True)))
    votes = votes.select("row", "doc_id", "n_words", "template", "label", "base", "size", "n_grams", "place", (F.col("at") - F.col("place")).alias("diagonal")).repartition("row")
    keys = ["row", "doc_id", "n_words", "template", "label", "base", "size", "n_grams"]
    lines = votes.groupBy(*keys, "diagonal").agg(F.collect_set("place").alias("places"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    lines = lines.withColumn("cluster", F.sum(apart.cast("int")).over(along))
    begin, end = F.min(F.col("diagonal") + F.array_min("places")), F.max(F.col("diagonal") + F.array_max("places")) + 2
    merged = lines.groupBy(*keys, "cluster").agg(begin.alias("begin"), end.alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("voted"))
    coverage = F.col("voted") / F.col("n_grams")
    span = F.struct("label", "base", F.col("begin").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), coverage.alias("coverage"))
    accepted = F.col("template").isNotNull() & F.when(F.col("base"), F.col("voted") == F.col("n_grams")).otherwise(coverage >= ACCEPT)
    found = merged.withColumn("span", F.when(accepted, span)).groupBy("row", "doc_id", "n_words").agg(F.collect_list("span").alias("spans"))
    return found.select("doc_id", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), F.array_sort("spans").alias("spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents")).withColumn("places", F.filter("spans", lambda s: s.base))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    starts = F.transform("places", lambda s: s.start)
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("places").alias("base_labels"), joined("spans").alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s.coverage)), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    values = ", ".join(f"({t}, '{x}', {b}, {n}, {g}, {k}, '{w1}', '{w2}')" for t, x, b, n, g, k, w1, w2 in template_grams())
    return rf"""
with grams(template, label, base, size, n_grams, place, t1, t2) as (values {values}),
texts as (select row_number() over () r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
rolling as (select r, unnest(range(0, len(w) - 1)) d, unnest(w[:-2]) w1, unnest(w[2:]) w2 from texts where len(w) > 1),
lines as (select r, template, label, base, n_grams, d - place diagonal, list(distinct place) places from rolling join grams on w1 = t1 and w2 = t2 group by all),
marked as (select *, case when base or coalesce(diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {GAP}, true) then 1 else 0 end apart from lines),
clustered as (select *, sum(apart) over (partition by r, template order by diagonal) c from marked),
merged as (select r, template, label, base, c, min(diagonal) begins, len(list_distinct(flatten(list(places)))) / any_value(n_grams) coverage from clustered group by all),
spans as (select * from merged where coverage >= case when base then 1 else {ACCEPT}e0 end),
found as (select r, count(*) filter (base) n_base, min(begins) filter (base) first_word, max(begins) filter (base) last_word,
  string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) labels, max(coverage) score from spans group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, cast(first_word as bigint) first_word, cast(last_word as bigint) last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, cast(coalesce(score, 0) as double) score from texts left join found using (r)"""


QUERIES = {"op3_licenses": op3_licenses}
ORACLE = {"op3_licenses": _oracle()}
