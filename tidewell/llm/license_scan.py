"""License scan: an exact set-similarity (containment) join of text blocks with license templates.

DataFrame operations only. A block is a line of a text, or a run of words over several lines that is at most
``1 / threshold`` times as long as the template. A block holds a template when at least ``ceil(threshold * |T|)`` of the
template's distinct words occur in it; a phrase is a template that must be held whole, with its words standing
consecutively, anywhere in the text.

1. Words are ordered by their global frequency: the number of texts, over all rows, that hold them, rarest first,
   ties by the word. Only template words can overlap, so only they are counted.
2. A block that holds ``o`` of ``|T|`` words holds at least one of the ``|T| - o + 1`` rarest. These prefixes are an
   inverted index (word to template, place, size); texts that hold none of its words are left out, and the words of the
   others are joined with it, which gives the pairs of block and template that are looked at.
3. Length filter, in the join: blocks with fewer than ``o`` template words are dropped. Positional filter: at the first
   common prefix word, the words left on both sides bound the overlap.
4. Candidates are verified by joining all their words with all words of the template.
5. Texts that hold enough of a template's words in all are read again for notices that lines break: a window begins at
   each of these words outside the lines found in 4, and its distinct words are counted.

What is found depends on the text alone, so it goes back to the rows by 128 bits of hash of the text. The template side
is a parameter of the program (some hundred words), never data, and is the broadcast side of every join.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, lower_ascii, small

#: What separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and the label that each gives.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices that stand in file headers and documents, by label.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted free of charge to any person obtaining a copy of this software",
        "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so subject to the following conditions",
    ],
    "apache": [
        "Licensed under the Apache License Version 2.0",
        "you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied",
    ],
    "gpl": [
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version",
        "This program is distributed in the hope that it will be useful but WITHOUT ANY WARRANTY without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms with or without modification are permitted",
        "Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": ["Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License",
        "If a copy of the MPL was not distributed with this file You can obtain one at mozilla org MPL 2.0",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc": ["This work is licensed under a Creative Commons Attribution International License"],
    "spdx": ["SPDX License Identifier"],
    "proprietary": ["All rights reserved unauthorized copying of this file is strictly prohibited"],
}


@dataclass(frozen=True)
class Rule:
    label: str
    words: tuple[str, ...]  # distinct, rarest first
    need: int  # words that must be shared
    span: int  # words of a window

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def _words(text: str) -> list[str]:
    return [w for w in re.split(GAP, "".join(c.lower() if c.isascii() else c for c in text)) if w]


def canonical(text: Column) -> Column:
    """The words of a text, each with one space before and after it; a lone space if there is none."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), GAP, " ")


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def word_ranks(docs: DataFrame, text_col: str, vocabulary: set[str]) -> dict[str, int]:
    """Template words by global frequency, rarest first. The result has a row for each template word at most."""
    vocabulary = sorted(vocabulary)
    # distinct words of a text that are in the vocabulary; the group-by is pre-aggregated in each task
    found = docs.select(F.explode(F.array_intersect(_literal(vocabulary), F.split(canonical(F.col(text_col)), " "))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _labelled(label: str):
    return lambda start: F.struct(start.alias("start"), F.lit(label).alias("label"))


def rules(ranks: dict[str, int], templates: dict[str, list[str]], threshold: float) -> list[Rule]:
    made = []
    for label, texts in templates.items():
        for text in texts:
            words = sorted(set(_words(text)), key=ranks.__getitem__)
            if words:
                made.append(Rule(label, tuple(words), math.ceil(threshold * len(words) - 1e-9), math.ceil(len(_words(text)) / threshold - 1e-9)))
    return made


def _index(spark, made: list[Rule]) -> DataFrame:
    """``word, rule, label, at, size, need, span, first``: each word of each template, ``at`` its place by rarity and
    ``first`` whether it belongs to the prefix."""
    names = ("word", "rule", "label", "at", "size", "need", "span", "first")
    return _table(spark, names, [(w, n, r.label, k, len(r.words), r.need, r.span, k < len(r.prefix)) for n, r in enumerate(made) for k, w in enumerate(r.words)])


def _table(spark, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """Rows of the program as a table that the plan itself holds."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return F.broadcast(spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*"))


def text_blocks(texts: DataFrame, made: list[Rule], ranks: dict[str, int]) -> DataFrame:
    """``k1, k2, block, rule, label, containment``: the lines of texts (``k1, k2, text``) that hold a template, and the
    lines where windows over several lines begin that hold one."""
    spark = texts.sparkSession
    index = _index(spark, made)
    order = _table(spark, ("word", "rank"), sorted(ranks.items(), key=lambda x: x[1]))
    lines = texts.select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("block", "line"))
    # places count all words of a text, so lines know how many words stand before them
    counted = lines.withColumn("ws", F.filter(F.split(canonical(F.col("line")), " "), lambda w: w != ""))
    by_text = Window.partitionBy("k1", "k2").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum(F.size("ws")).over(by_text), F.lit(0)))
    words = placed.select("k1", "k2", "block", "before", F.posexplode("ws").alias("p", "word")).join(order, "word")
    words = durable(words.select("k1", "k2", "block", (F.col("before") + F.col("p")).cast("int").alias("place"), "word", "rank"))
    block = ["k1", "k2", "block"]
    own = words.select(*block, "word", "rank").distinct()
    sized = own.withColumn("left", F.row_number().over(Window.partitionBy(*block).orderBy(F.desc("rank"))))  # this word and rarer ones' followers
    total = own.groupBy(*block).agg(F.count(F.lit(1)).alias("own"))
    met = sized.join(total, block).join(index.where("first"), "word").where("own >= need")  # prefix and length
    first = met.groupBy(*block, "rule", "need", "size").agg(F.min_by(F.struct("left", "at"), "rank").alias("f"))
    candidates = first.where(F.least(F.col("f.left"), F.col("size") - F.col("f.at")) >= F.col("need")).select(*block, "rule")  # positional
    shared = own.join(index.select("word", "rule", "label", "size", "need"), "word").join(candidates, [*block, "rule"], "left_semi")
    held = shared.groupBy(*block, "rule", "label", "size", "need").agg(F.count(F.lit(1)).alias("shared")).where("shared >= need")
    whole = durable(held.select(*block, "rule", "label", (F.col("shared") / F.col("size")).alias("containment")))
    # windows: of the words outside those lines, where the text as a whole holds enough
    hits = words.join(index.select("word", "rule", "label", "size", "need", "span"), "word")
    text = ["k1", "k2", "rule"]
    enough = hits.groupBy(*text, "need").agg(F.count_distinct("word").alias("n")).where("n >= need").select(*text)
    open_ = hits.join(enough, text, "left_semi").join(whole.select(*block, "rule"), [*block, "rule"], "left_anti")
    # one frame for windows of all lengths: a rule's places are stretched so that its span is what the frame holds
    frame = max(r.span * (r.span - 1) for r in made) + 1
    stretch = F.expr(f"CAST(place AS BIGINT) * (CASE WHEN span > 1 THEN {frame} DIV (span - 1) ELSE {frame + 1} END)")
    window = Window.partitionBy(*text).orderBy("stretched").rangeBetween(0, frame)
    found = open_.withColumn("stretched", stretch).withColumn("n", F.size(F.collect_set("word").over(window))).where("n >= need")
    broken = found.groupBy(*block, "rule", "label").agg(F.max(F.col("n") / F.col("size")).alias("containment"))
    return whole.union(broken.select(whole.columns))


def license_scan(
    docs: DataFrame,
    text_col: str = "text",
    threshold: float = 0.8,
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with ``n_words, places, blocks`` added.

    ``places``: array of (start, label), one for each place where a phrase's words stand consecutively, words counted
    from 0. ``blocks``: array of (block, label, containment), one for each line (from 0) and template that reaches the
    threshold, and one for each template and line where windows over several lines begin that reach it. Null texts
    count as empty; empty texts have no words, places or blocks. Columns of ``docs`` that have one of the three names
    are replaced; all others pass through, whatever their names. Rows may repeat. An empty table stays empty.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    vocabulary = {w for x in templates.values() for t in x for w in _words(t)} | {w for p in phrases for w in _words(p)}
    ranks = word_ranks(docs, text_col, vocabulary)
    made = rules(ranks, templates, threshold)
    kept = docs.drop("n_words", "places", "blocks")
    names = [f"c{k}" for k in range(len(kept.columns))]
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")) if text_col not in kept.columns else F.coalesce(F.col(names[kept.columns.index(text_col)]).cast("string"), F.lit(""))
    base = kept.toDF(*names).withColumn("text", text)
    base = base.withColumns({"canon": canonical(F.col("text")), "k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(5), "text")})
    spaces = F.octet_length("canon") - F.octet_length(F.replace("canon", F.lit(" "), F.lit("")))

    # phrases: containment 1, so the prefix is the rarest word alone; then the words' places. The text is split at
    # the first word of each place, so places that overlap are all found.
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    no_blocks = F.array().cast("array<struct<block:int,label:string,containment:double>>")
    count = lambda piece: (F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit(" "), F.lit(""))) - 1).cast("bigint")
    places = []
    for phrase, label in phrases.items():
        p = _words(phrase)
        rarest = min(p, key=ranks.__getitem__)
        candidate = F.contains("canon", F.lit(f" {rarest} ")) & F.contains("canon", F.lit(" " + " ".join(p) + " "))
        pieces = F.split("canon", f"(?<= ){p[0]}(?= {''.join(w + ' ' for w in p[1:])})" if len(p) > 1 else f"(?<= ){p[0]}(?= )", -1)
        found = F.aggregate(
            F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
            F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("found")),
            lambda acc, piece: F.struct(
                (acc["at"] + count(piece) + 1).alias("at"), F.concat(acc["found"], F.array(acc["at"] + count(piece))).alias("found")
            ),
            lambda acc: acc["found"],
        )
        places.append(F.when(candidate, F.transform(found, _labelled(label))).otherwise(none))
    rows = base.withColumns({"n_words": F.greatest(spaces - 1, F.lit(0)).cast("bigint"), "places": F.concat(*places) if places else none})
    restored = [F.col(n).alias(c) for n, c in zip(names, kept.columns)]
    if not made:
        return rows.select(*restored, "n_words", "places", no_blocks.alias("blocks"))
    prefixes = sorted({w for rule in made for w in rule.prefix})
    asked = base.where(F.arrays_overlap(F.split("canon", " "), _literal(prefixes))).select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    each = F.struct(F.col("block").cast("int").alias("block"), "label", "containment")
    of_text = text_blocks(asked, made, ranks).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(each)).alias("blocks"))
    met = rows.join(small(durable(of_text)), ["k1", "k2"], "left")
    return met.select(*restored, "n_words", "places", F.coalesce(F.col("blocks").cast("array<struct<block:int,label:string,containment:double>>"), no_blocks).alias("blocks"))
