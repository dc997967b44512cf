"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A template matches where a run of words, across lines and at most SPREAD times as long as the template, holds at least
THRESHOLD of its words and all of those that tell it from its siblings. Runs are looked for in blocks: stretches of text in
which no more words in a row than the longest run belong to no template. Template words are ordered by how many blocks
hold them, rarest first; a match must then share one of a template's first few words, its block must hold enough words in
all, and must have enough of them left after the first shared one. The texts of the few documents that pass are read
again, and a match's run is looked for in them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import MARK_CLASS, cut, if_small, lower_ascii

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
THRESHOLD, SPREAD = 0.8, 2.0
#: Words of all templates that a broadcast may hold; with more, the joins shuffle.
MAX_WORDS = 100_000
#: Documents and templates to look at again that a broadcast may hold.
MAX_CANDIDATES = 200_000
#: Fixed values: (label, words of a license's notice), as plain text; + marks words that must be there.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this +software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and +noninfringement"),
    ("mit", "released under the +mit license"),
    ("isc", "permission to use copy modify and or +distribute this software for any purpose with or without fee is hereby granted"),
    ("apache", "licensed under the +apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the +gnu +general public license"),
    ("gpl", "this work is licensed under the +gnu +general public license version 3"),
    ("lgpl", "under the terms of the gnu +lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu +affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the +mozilla public license"),
    ("epl", "made available under the terms of the +eclipse public license"),
    ("boost", "distributed under the +boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public +domain"),
    ("cc-by", "this work is licensed under a creative commons +attribution international license"),
    ("cc-by-nc", "licensed under +cc by +nc 4 0"),
    ("cc-by-sa", "licensed under +cc by +sa 4 0"),
    ("cc-by-nd", "licensed under +cc by +nd 4 0"),
    ("proprietary", "copyright all rights +reserved"),
)


def lowered(text: Column) -> Column:
    """Lower case; words of ASCII come out as if only A-Z were lowered, for the two letters whose lower case has ASCII
    in it go the slower way."""
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.when(odd, lower_ascii(text)).otherwise(F.lower(text))


def template_sets(templates) -> list[tuple[int, str, list[str], list[str], int, int]]:
    """(number, label, distinct words, those that must be there, words needed, longest run)."""
    out = []
    for k, (label, text) in enumerate(templates):
        words = text.split()
        known = sorted({w.lstrip("+") for w in words})
        out.append((k, label, known, sorted({w[1:] for w in words if w[0] == "+"}), math.ceil(THRESHOLD * len(known) - 1e-9), math.ceil(SPREAD * len(words))))
    return out


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def blocks_of(words: Column, known: list[str], least: int, gap: int) -> Column:
    """(number of the block's first word, distinct known words) of blocks with at least so many of them; known words that
    are further apart than `gap` are in different blocks."""
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(known))
    opens = lambda hits: F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: (i == 0) | (F.get(hits, i)["at"] - F.get(hits, i - 1)["at"] > gap))
    block = lambda hits, first, k, start: F.struct(
        F.get(hits, start)["at"].alias("block"),
        F.array_distinct(F.transform(F.slice(hits, start + 1, F.coalesce(F.get(first, k + 1), F.size(hits)) - start), lambda x: x["word"])).alias("hits"),
    )
    cut_up = lambda hits: bound(opens(hits), lambda first: F.transform(first, lambda start, k: block(hits, first, k, start)))
    none = F.slice(F.array(F.struct(F.lit(0).alias("block"), F.array(F.lit("")).alias("hits"))), 1, 0)
    return F.filter(bound(places, lambda hits: F.when(F.size(hits) >= least, cut_up(hits)).otherwise(none)), lambda x: F.size(x["hits"]) >= least)


def scanned_texts(docs: DataFrame, phrases: Mapping[str, str], known: list[str], least: int, gap: int) -> DataFrame:
    """(doc_id, text_hash, n_words, base, blocks), from one pass over the texts: places of phrases with their labels,
    and blocks that hold at least so many known words."""
    text = lowered(F.coalesce("text", F.lit("")))
    maybe = F.lit(False)
    for p in phrases:
        whole = F.lit(True)
        for w in p.split():
            whole = whole & text.contains(w)
        maybe = maybe | whole
    none = F.slice(F.array(F.struct(F.lit("").alias("label"), F.lit(0).alias("place"))), 1, 0)
    named = lambda places, label: F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.alias("place")))
    base = lambda words: F.concat(none, *[named(phrase_places(words, p), label) for p, label in phrases.items()])
    parsed = bound(
        F.filter(F.split(text, MARK_CLASS), lambda x: x != ""),
        lambda words: F.struct(F.size(words).cast("long").alias("n_words"), F.when(maybe, base(words)).otherwise(none).alias("base"), blocks_of(words, known, least, gap).alias("blocks")),
    )
    # As a generator's columns, these aren't worked out again by each of their uses.
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(F.array(parsed)))


def similar_blocks(scanned: DataFrame, sets: list[tuple[int, str, list[str], list[str], int, int]]) -> DataFrame:
    """(doc_id, text_hash, template): templates of which some block holds enough words and all that must be there."""
    spark = scanned.sparkSession
    key = ["doc_id", "text_hash", "block"]
    blocks = scanned.where(F.size("blocks") > 0).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.inline("blocks"))
    freq = scanned.select(F.explode(F.flatten("blocks.hits")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    # From here the tables on the other side have a row for each template word: their size is that of the templates.
    pairs = spark.createDataFrame([(k, w, len(words), need) for k, _, words, _, need, _ in sets for w in words], "template int, word string, size int, need int")
    ranks = cut(pairs.select("word").distinct().join(freq, "word", "left").select("word", F.row_number().over(Window.orderBy(F.coalesce("freq", F.lit(0)), "word")).alias("rank")))
    pairs = pairs.join(if_small(ranks, MAX_WORDS), "word").withColumn("place", F.row_number().over(Window.partitionBy("template").orderBy("rank")))
    prefix = if_small(cut(pairs.where("place <= size - need + 1").select("template", "word", "size", "need", "place")), MAX_WORDS)
    whole = if_small(spark.createDataFrame([(k, words, must) for k, _, words, must, *_ in sets], "template int, words array<string>, must array<string>"), MAX_WORDS)
    rare = if_small(prefix.select("word").distinct(), MAX_WORDS)

    # Blocks without any word of a prefix go first, unshuffled.
    hit = blocks.select("*", F.explode("hits").alias("word")).join(rare, "word", "left_semi").drop("word").distinct()
    placed = hit.withColumn("n", F.size("hits")).select("*", F.explode("hits").alias("word")).join(if_small(ranks, MAX_WORDS), "word")
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("rank")))
    meets = placed.join(prefix, "word").where(F.col("n") >= F.col("need"))
    first = meets.groupBy(*key, "template").agg(F.min("place").alias("place"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("size").alias("size"), F.first("need").alias("need"), F.first("hits").alias("hits"))
    left = 1 + F.least(F.col("size") - F.col("place"), F.col("n") - F.col("at"))
    checked = first.where(left >= F.col("need")).join(whole, "template").withColumn("overlap", F.size(F.array_intersect("hits", "words")))
    met = (F.col("overlap") >= F.col("need")) & (F.size(F.array_except("must", "hits")) == 0)
    return checked.where(met).select("doc_id", "text_hash", "template").distinct()


def matching_runs(docs: DataFrame, candidates: DataFrame, sets: list[tuple[int, str, list[str], list[str], int, int]]) -> DataFrame:
    """(doc_id, text_hash, label, share) of candidates (doc_id, text_hash, template) whose text has a run that matches, with
    the largest share of the template's words that one holds."""
    spark = docs.sparkSession
    wanted = if_small(cut(candidates.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})), MAX_CANDIDATES)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", "template", "text")
    whole = F.broadcast(spark.createDataFrame(sets, "template int, label string, known array<string>, must array<string>, need int, span int"))
    words = F.filter(F.split(lowered(F.col("text")), MARK_CLASS), lambda w: w != "")
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains("known", x["word"]))
    rows = rows.join(whole, "template").select("doc_id", "text_hash", "label", "known", "must", "need", "span", F.inline(F.array(F.struct(places.alias("hits")))))

    def overlap(hits: Column, i: Column) -> Column:
        end = F.get(hits, i)["at"] + F.col("span")
        run = F.array_distinct(F.transform(F.filter(F.slice(hits, i + 1, F.col("span")), lambda x: x["at"] < end), lambda x: x["word"]))
        return bound(run, lambda r: F.when(F.size(F.array_except("must", r)) == 0, F.size(r)).otherwise(0))

    best = F.array_max(F.transform("hits", lambda x, i: overlap(F.col("hits"), i)))
    return rows.withColumn("best", best).where("best >= need").select("doc_id", "text_hash", "label", (F.col("best") / F.size("known")).alias("share"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of every place where the phrase's words stand one after the other; may overlap."""
    parts = phrase.split()
    n = len(parts)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(words, i + 1, n) == F.array(*map(F.lit, parts)))


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    The score is 1 if a phrase stands in the text, else the largest share of a matching template's words that one run
    holds, else 0. Null and empty texts have no words and no labels; rows that share id and text get
    equal results; an empty table gives an empty result. Only doc_id and text are read."""
    sets = template_sets(templates)
    known, least = sorted({w for _, _, words, *_ in sets for w in words}), min(s[4] for s in sets)
    scanned = cut(scanned_texts(docs, phrases, known, least, max(s[5] for s in sets)))
    found = matching_runs(docs, similar_blocks(scanned, sets), sets).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    found = found.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    rows = scanned.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    show = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.place").cast("long").alias("first_word"), F.array_max("base.place").cast("long").alias("last_word"),
        show(F.col("base.label")).alias("base_labels"),
        show(F.concat("base.label", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op5_licenses(spark, sf_dir):
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    listed = lambda words: f"['{"','".join(words)}']" if words else "CAST([] AS VARCHAR[])"
    phrases = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in PHRASES.items())
    sets = ", ".join(f"('{label}', {listed(words)}, {listed(must)}, {need}, {span}, {k})" for k, label, words, must, need, span in template_sets(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(regexp_extract_all({low.format("text")}, {word}), []) AS w FROM documents),
p(ph, label) AS (VALUES {phrases}), t(label, ws, must, need, span, k) AS (VALUES {sets}),
b AS (SELECT r, label, s - 1 AS pos FROM (SELECT r, w, ph, label, unnest(range(1, len(w) - len(ph) + 2)) AS s FROM d, p WHERE list_contains(w, ph[1]))
      WHERE w[s : s + len(ph) - 1] = ph),
bb AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
k AS (SELECT DISTINCT unnest(ws) AS word FROM t),
h AS (SELECT r, i, word FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) JOIN k USING (word)),
x AS (SELECT r, k, i, word, span FROM h JOIN (SELECT k, span, unnest(ws) AS word FROM t) USING (word)),
l AS (SELECT a.r, a.k, list(DISTINCT b.word) AS run FROM x a JOIN x b ON a.r = b.r AND a.k = b.k AND b.i >= a.i AND b.i < a.i + a.span GROUP BY a.r, a.k, a.i),
m AS (SELECT r, label, len(run) / len(ws) AS share FROM l JOIN t USING (k) WHERE len(run) >= need AND list_has_all(run, must)),
ms AS (SELECT r, max(share) AS share FROM m GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN ms USING (r) LEFT JOIN al USING (r)"""


OP5_SQL = _sql()
