"""Licence scan: a positional index of rare licence words, aligned by relative position and verified by key phrases."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnsearch.llm.common import join_hot, store

#: The phrases that are looked for everywhere, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, text and mandatory key phrase of known licence notices, in words as ``words_of`` makes them.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed "
        "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations under "
        "the license",
        "you may not use this file except in compliance with the license",
    ),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program "
        "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "redistribute it and or modify it under the terms of the gnu general public license",
    ),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile "
        "sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non "
        "commercial and by any means",
        "free and unencumbered software released into the public domain",
    ),
]
#: Indexed words of a template, and words of a file that are looked up.
INDEXED, LOOKED_UP = 12, 8
ALIGNED = 0.75
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words as an array, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def rarity(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, float]:
    """IDF of each licence word over all documents: one row per word comes back, never more."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.explode(F.array_intersect(known, words_of(F.col(text_col)))).alias("word"))
    counts = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    total = docs.count()
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def postings_of(spark, templates: list[tuple[str, str, str]], idf: dict[str, float], indexed: int) -> DataFrame:
    """``(word, label, place, weight, whole)``: every place of each template's ``indexed`` rarest words.

    ``weight`` is the word's IDF over its number of places in the template, ``whole`` the sum of them all. A row per place, so
    the index is as large as the templates, whatever is scanned.
    """
    rows = []
    for label, template, _ in templates:
        words = template.split()
        rarest = sorted(set(words), key=lambda w: (-idf[w], w))[:indexed]
        whole = sum(idf[w] for w in rarest)
        rows += [
            {"word": w, "label": label, "place": i, "weight": idf[w] / words.count(w), "whole": whole}
            for i, w in enumerate(words)
            if w in rarest
        ]
    kind = "array<struct<word:string,label:string,place:int,weight:double,whole:double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str, str]] = TEMPLATES,
    indexed: int = INDEXED,
    looked_up: int = LOOKED_UP,
    aligned: float = ALIGNED,
) -> DataFrame:
    """``(id, n_words, places, base_labels, labels, score)`` of every whole text; ``places`` are word indexes.

    The index is a table of postings: the places of each template's ``indexed`` rarest words, by their IDF over all
    documents. Of a file, the ``looked_up`` rarest words that the index has are looked up; each meeting of a place in the file and
    one in a template tells where the template would begin. What begins at one place is added up over all indexed words of
    the file: the alignment is the share of the template's indexed weight that stands right from there. From
    ``aligned`` on, and with the template's key phrase in the text, its label is added. ``score`` is 1 with a base place, else
    the best verified alignment.

    Null and empty texts have no words, empty labels and score 0. Rows with null or repeated ids are scanned like
    any others; other columns are left out. An empty table gives an empty result. Texts are read, never shuffled; places
    of indexed words are, if their file may hold a template.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, template, _ in templates for w in template.split()})
    idf = rarity(docs, vocabulary, text_col)
    index = postings_of(spark, templates, idf, indexed)
    rare = sorted({w for _, t, _ in templates for w in sorted(set(t.split()), key=lambda w: (-idf[w], w))[:indexed]})
    known, last_words = F.array(*[F.lit(w) for w in rare]), F.array(*[F.lit(p.split()[-1]) for p in phrases])
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")
    )
    # most files have neither a phrase's last word nor the rarest word of any key phrase, and are done with
    sure = {min(key.split(), key=lambda w: (-idf[w], w)) for _, _, key in templates} - {p.split()[-1] for p in phrases}
    asked = F.arrays_overlap("words", F.array_union(last_words, F.array(*[F.lit(w) for w in sorted(sure)])))
    rows = rows.select("row", "id", F.size("words").cast("long").alias("n_words"), F.when(asked, F.col("words")).alias("words"))
    rows = rows.withColumn("found", F.when(F.col("words").isNotNull(), F.array_intersect(known, F.col("words"))))
    line = F.when(F.col("words").isNotNull(), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    rows = rows.withColumn("line", line)

    def stands(phrase: str) -> Column:
        parts = phrase.split()

        def here(i: Column) -> Column:
            match = F.lit(True)
            for k, part in enumerate(parts):
                match = match & F.coalesce(F.get("words", i + k) == part, F.lit(False))
            return match

        return F.when(
            F.contains("line", F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
        )

    nothing = F.array().cast("array<int>")
    keyed = F.array(*[F.when(F.contains("line", F.lit(f" {key} ")), F.lit(label)) for label, _, key in templates])
    keys = F.when(F.size("found") > 0, F.filter(keyed, lambda x: x.isNotNull()))
    rows = rows.withColumns({f"base{k}": F.coalesce(stands(p), nothing) for k, p in enumerate(phrases)})
    weights = F.create_map(*[x for w in rare for x in (F.lit(w), F.lit(idf[w]))])
    by_rarity = F.array_sort(F.transform("found", lambda w: F.struct((-F.element_at(weights, w)).alias("rank"), w.alias("word"))))
    rows = rows.withColumns({"keys": keys, "asked": F.slice(by_rarity, 1, looked_up)["word"]})
    # without a key phrase no label can follow, so only files that have one give their places
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: F.array_contains("found", h["word"]))
    rows = rows.withColumn("hits", F.when(F.size("keys") > 0, hits))
    scanned = store(
        rows.select("row", "id", "n_words", "keys", "asked", "hits", *[f"base{k}" for k in range(len(phrases))]), "license-scan"
    )

    with_keys = scanned.filter("size(hits) > 0")
    places = with_keys.select("row", "keys", "asked", F.explode("hits").alias("hit")).select("row", "keys", "asked", "hit.*")
    met = places.join(F.broadcast(index), "word").filter(F.array_contains("keys", F.col("label")))
    starts = met.groupBy("row", "label", (F.col("at") - F.col("place")).alias("start")).agg(
        F.sum("weight").alias("matched"),
        F.max("whole").alias("whole"),
        F.max(F.array_contains("asked", F.col("word"))).alias("looked_up"),
    )
    share = F.round(F.max(F.when(F.col("whole") > 0, F.col("matched") / F.col("whole")).otherwise(0.0)), 6)
    verified = starts.filter("looked_up").groupBy("row", "label").agg(share.alias("share")).filter(F.col("share") >= aligned)
    own = verified.groupBy("row").agg(
        F.array_sort(F.collect_set("label")).alias("own"), F.max("share").alias("best"), F.lit(1).cast("long").alias("n")
    )
    joined = join_hot(scanned, own, ["row"], "n", scanned.count())
    base_labels = F.filter(
        F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]), lambda x: x.isNotNull()
    )
    base = F.flatten(F.array(*[F.col(f"base{k}") for k in range(len(phrases))]))
    more = F.coalesce("own", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        base.alias("places"),
        F.array_sort(F.array_distinct(base_labels)).alias("base_labels"),
        F.array_sort(F.array_union(base_labels, more)).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
