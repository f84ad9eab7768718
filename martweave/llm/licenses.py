"""Licence notices found by a positional index of rare words, with DataFrame functions only.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case.
A document keeps its licence words (those of ``TEMPLATES``) with their places. Base places are
where the words of a base phrase stand one after the other.

The method looks a document's rarest licence words up. Document counts over the whole corpus
give every licence word its weight, 1 + floor(1000 * ln((2N + 2) / (2df + 1))), N being the
documents and df those with the word. The index holds the ``RARE`` places of highest weight of
every template. A document's occurrences of indexed words meet the postings of the same word;
place in the document less place in the template is where the template would begin, and
postings that agree on it add up. A beginning whose indexed words carry at least ``SHARE``
percent of the template's indexed weight is verified: every mandatory phrase of the template
must stand at its relative place. The template's label is then added; ``score`` is the largest
share among verified beginnings as a number from 0 to 1, 0 without any.

All steps cost time in proportion to the licence words of a text: postings are summed per
beginning and phrases met by place, so a text that repeats a notice a million times has a
million beginnings and no pairs of them. Templates and index are constants of a few hundred
rows.

Whole texts are read. A null text is empty: it has no words, null places, no labels and score
0. Rows that repeat a doc_id or a text are rows of their own and are judged alike. A null doc_id
is kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import stage
from martweave.llm.privacy import let

RARE = 6
SHARE = 70
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice, mandatory phrases (parts of the notice), in the licences' own words.
TEMPLATES = [
    ("cc-by", "CC BY", ["CC BY"]),
    ("gpl", "General Public License", ["General Public License"]),
    ("reserved", "All rights reserved", ["All rights reserved"]),
    ("mit", "MIT License", ["MIT License"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ["hereby granted, free of charge", "without restriction"]),
    ("apache-2.0", "Apache License, Version 2.0", ["Apache License, Version 2.0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0", ["apache.org/licenses/LICENSE-2.0"]),
    ("gpl-2.0", "GNU General Public License, version 2", ["GNU General Public License, version 2"]),
    ("gpl-3.0", "GNU General Public License, version 3", ["GNU General Public License, version 3"]),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
     ["GNU General Public License", "either version 2"]),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
     ["GNU General Public License", "either version 3"]),
    ("lgpl", "GNU Lesser General Public License", ["Lesser General Public License"]),
    ("agpl", "GNU Affero General Public License", ["Affero General Public License"]),
    ("mpl-2.0", "Mozilla Public License, v. 2.0", ["Mozilla Public License", "2.0"]),
    ("mpl-2.0", "Mozilla Public License, Version 2.0", ["Mozilla Public License", "2.0"]),
    ("epl-2.0", "Eclipse Public License v. 2.0", ["Eclipse Public License", "2.0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met", ["source and binary forms"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission",
     ["endorse or promote products"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("cc-by-4.0", "CC BY 4.0", ["CC BY 4.0"]),
    ("cc-by-sa-4.0", "CC BY-SA 4.0", ["CC BY-SA 4.0"]),
    ("cc-by-nc-4.0", "CC BY-NC 4.0", ["CC BY-NC 4.0"]),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0", ["CC BY-NC-SA 4.0"]),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International", ["Creative Commons Attribution 4.0"]),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", ["Creative Commons Attribution-ShareAlike 4.0"]),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", ["Creative Commons Attribution-NonCommercial 4.0"]),
    ("cc0-1.0", "CC0 1.0 Universal", ["CC0 1.0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]


def cut(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def key_places(notice: str, phrases: list[str]) -> list[int]:
    """Places in the notice that its mandatory phrases take, each phrase where it first stands."""
    words, out = cut(notice), set()
    for phrase in map(cut, phrases):
        at = next(i for i in range(len(words)) if words[i: i + len(phrase)] == phrase)
        out.update(range(at, at + len(phrase)))
    return sorted(out)


NOTICES = [(label, cut(notice), key_places(notice, phrases)) for label, notice, phrases in TEMPLATES]
VOCABULARY = sorted({w for _, words, _ in NOTICES for w in words} | {w for p in BASE for w in cut(p)})
KEY_WORDS = sorted({words[i] for _, words, keys in NOTICES for i in keys})


def weight(n: int, df: int) -> int:
    return 1 + math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def licence_words(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, and ``hits``: the licence words of every document with their places, ascending."""
    # The only letter outside A-Z that lower() makes an ASCII word of its own is the Kelvin sign.
    plain = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))

    def read(pieces: Column) -> Column:
        lead = (pieces[0] == "").cast("int")
        tail = ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
        hit = lambda w, i: F.when(w.isin(VOCABULARY), F.struct(w.alias("w"), (i - lead).cast("long").alias("at")))
        return F.struct((F.size(pieces) - lead - tail).cast("long").alias("n_words"), F.filter(F.transform(pieces, hit), lambda h: h.isNotNull()).alias("hits"))

    found = let(F.split(plain, SEPARATOR, -1), read)
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("f")).select("row", "doc_id", "f.n_words", "f.hits")


def base_places(hits: Column, phrase: str) -> Column:
    """Places where the words of the phrase stand one after the other."""
    words = cut(phrase)

    def starts(own: Column) -> Column:
        def here(h: Column, i: Column) -> Column:
            same = h["w"] == words[0]
            for j, w in enumerate(words[1:], 1):
                later = F.get(own, i + j)
                same = same & (later["w"] == w) & (later["at"] == h["at"] + j)
            return F.when(same, h["at"])

        return F.filter(F.transform(own, here), lambda at: at.isNotNull())

    return let(F.filter(hits, lambda h: h["w"].isin(words)), starts)


def weights(found: DataFrame) -> dict[str, int]:
    """Weight of every licence word; one count per word comes back."""
    words = F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")
    df = {r.w: r.n for r in found.select(words).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = found.count()
    return {w: weight(n, df.get(w, 0)) for w in VOCABULARY}


def index(weigh: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(word, template, place, weight): the ``RARE`` heaviest places of every template, the first of equal ones."""
    out = []
    for t, (_, words, _) in enumerate(NOTICES):
        heavy = sorted(range(len(words)), key=lambda i: (-weigh[words[i]], i))[:RARE]
        out += [(words[i], t, i, weigh[words[i]]) for i in heavy]
    return out


def _constants(spark, names: str, rows: list[tuple]) -> DataFrame:
    listed = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({names})")


def notices(found: DataFrame, weigh: dict[str, int]) -> DataFrame:
    """(row, label, begins, share): verified beginnings of templates; ``share`` of weights as (got, whole)."""
    spark = found.sparkSession
    postings = index(weigh)
    whole: dict[int, int] = {}
    for _, t, _, v in postings:
        whole[t] = whole.get(t, 0) + v
    words = found.select("row", F.explode("hits").alias("h")).select("row", "h.w", "h.at")
    rare = words.filter(F.col("w").isin(sorted({p[0] for p in postings}))).join(_constants(spark, "w, template, place, weight", postings), "w")
    sums = rare.groupBy("row", "template", (F.col("at") - F.col("place")).alias("begins")).agg(F.sum("weight").alias("got"))
    totals = _constants(spark, "template, whole", sorted(whole.items()))
    likely = stage(sums.filter("begins >= 0").join(totals, "template").filter(F.col("got") * 100 >= F.col("whole") * SHARE), "licence-candidates")
    keys = _constants(spark, "template, label, word, place, n_keys", [
        (t, label, own[i], i, len(k)) for t, (label, own, k) in enumerate(NOTICES) for i in k])
    needed = likely.join(keys, "template").select(
        "row", "template", "label", "begins", "got", "whole", "n_keys", (F.col("begins") + F.col("place")).alias("at"), F.col("word").alias("w"))
    there = words.filter(F.col("w").isin(KEY_WORDS))
    met = needed.join(there, ["row", "at", "w"]).groupBy("row", "template", "label", "begins", "got", "whole", "n_keys").agg(F.count(F.lit(1)).alias("met"))
    return met.filter("met = n_keys").select("row", "label", "begins", "got", "whole")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    found = stage(licence_words(docs), "licence-words")
    seen = notices(found, weights(found))
    added = stage(seen.groupBy("row").agg(
        F.collect_set("label").alias("added"), F.max(F.col("got") / F.col("whole")).alias("score")), "licence-notices")
    placed = found.select("row", "doc_id", "n_words", F.struct(*[base_places(F.col("hits"), p).alias(label) for p, label in BASE.items()]).alias("b"))
    every = F.concat(*[F.col("b").getField(label) for label in BASE.values()])
    base = F.filter(F.array(*[F.when(F.size(F.col("b").getField(label)) > 0, F.lit(label)) for label in BASE.values()]), lambda x: x.isNotNull())
    rows = placed.select("row", "doc_id", "n_words", every.alias("every"), base.alias("base"))
    joined = rows.join(added, "row", "left")
    all_labels = F.array_distinct(F.concat("base", F.coalesce("added", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").alias("first_word"), F.array_max("every").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(all_labels), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
