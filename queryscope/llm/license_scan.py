"""License scans by a positional rare-token index, with DataFrame functions only.

The words of highest IDF in each template's key phrases are indexed with their places. Wherever a file holds one of them,
it puts the template's beginning at one place; where all indexed words of a template agree on a beginning, the postings
intersect, and it counts if the key phrases stand where that beginning puts them. Key phrases are mandatory, so that
intersection loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of (template, beginning): the template number times this, plus the beginning, which lies within half of it.
_SPAN = 1 << 40
#: Fixed pattern: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed phrases and labels of the base scan.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Fixed texts: label, notice as licences word it, and the phrases that it must hold.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "apache license version 2 0 january 2004 terms and conditions for use reproduction and distribution", ("apache license", "terms and conditions")),
    ("apache-2.0", "spdx license identifier apache 2 0", ("license identifier apache 2 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "associated documentation files")),
    ("mit", "spdx license identifier mit", ("license identifier mit",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software", "gnu general public license")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("express or implied warranty", "authors be held liable")),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining", "accompanying documentation covered")),
    ("wtfpl", "do what the fuck you want to public license", ("what the fuck you want",)),
    ("artistic-2.0", "the artistic license 2 0 everyone is permitted to copy and distribute verbatim copies of this license document", ("artistic license",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("except in compliance with the license", "applicable law or agreed to in writing")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("deal in the software without restriction", "copies or substantial portions")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("published by the free software foundation", "merchantability or fitness for a particular purpose")),
    ("proprietary", "confidential and proprietary unauthorized copying of this file is strictly prohibited", ("strictly prohibited",)),
)
#: Most words that the index holds of a template.
_RARE = 3
#: Fixed words that are too common to index.
COMMON = ("a", "all", "and", "any", "are", "by", "can", "for", "form", "has", "in", "into", "is", "it", "made", "of", "or", "person", "related", "that", "the", "this", "to", "use", "with", "without", "you", "0", "2", "3", "4", "v")
#: What base phrases are found by, though the templates do not index it.
_ANCHORS = ("cc", "general", "rights")


def _vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()} - set(COMMON) | set(_ANCHORS))


def _templates():
    """Column: constant array of (label, words, phrases: array of (at, text)), by template number."""
    rows = []
    for label, text, phrases in TEMPLATES:
        words = text.split()
        at = [next(i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()) for p in phrases]
        held = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(p).alias("text"), F.lit(len(p.split())).alias("n")) for i, p in zip(at, phrases, strict=True)])
        rows.append(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), held.alias("phrases")))
    return F.array(*rows)


def _anchors(ranked: list[str]) -> tuple[dict[str, list[int]], list[int]]:
    """The positional index, from each word to the codes of a beginning at 0, and how many words it holds of each template.

    Of each template these are the first of ``ranked`` in its key phrases, each at its first place there.
    """
    index: dict[str, list[int]] = {}
    held = []
    for tpl, (_, text, phrases) in enumerate(TEMPLATES):
        words, places = text.split(), {}
        for p in (p.split() for p in phrases):
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            for k, w in enumerate(p):
                if w not in COMMON:
                    places.setdefault(w, at + k)
        chosen = sorted(places, key=ranked.index)[:_RARE]
        for word in chosen:
            index.setdefault(word, []).append(tpl * _SPAN - places[word])
        held.append(len(chosen))
    return index, held


def _postings(index: dict[str, list[int]]):
    """Column: the positional index as a constant map from each indexed word to its codes."""
    return F.create_map(*[x for word, places in sorted(index.items()) for x in (F.lit(word), F.array(*[F.lit(p).cast("long") for p in places]))])


def words_column(text_col: str = "text"):
    """Column: the words of a whole text, A-Z lower-cased; null counts as empty."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _places(words, phrase: str):
    """Column: where the phrase's words stand consecutively, from 0."""
    parts = phrase.split()
    tests = lambda w, i: [w == parts[0], *[F.get(words, i + k) == p for k, p in enumerate(parts) if k]]

    def here(w, i):
        first, *rest = tests(w, i)
        for t in rest:
            first = first & t
        return F.when(F.coalesce(first, F.lit(False)), i).otherwise(F.lit(-1))

    return F.array_remove(F.transform(words, here), -1)


def _let(value, use):
    """Column: ``use`` of ``value``, which is evaluated once however often ``use`` names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ranked_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The fixed vocabulary by falling IDF over all documents, ties by word; a row for each of its words is collected."""
    present = docs.select(F.array_intersect(F.array(*map(F.lit, _vocabulary())), words_column(text_col)).alias("lic"))
    df = {r["word"]: r["df"] for r in present.select(F.explode("lic").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}
    return sorted(_vocabulary(), key=lambda w: (df.get(w, 0), w))


def _accepted(words, top, postings, held: list[int], least_share: float):
    """Column: array of (label, share) of the templates that the file's indexed words ``top`` lead to and its words bear out."""
    pairs = F.transform(words, lambda w, i: F.when(F.array_contains(top, w), F.struct(w.alias("word"), i.cast("long").alias("pos"))))
    codes = F.flatten(F.transform(F.array_compact(pairs), lambda x: F.transform(F.element_at(postings, x["word"]), lambda p: p + x["pos"])))

    needed = F.array(*map(F.lit, held))

    def agreed(found):
        """The codes that occur as often as their template has indexed words, each once: sorted, equal ones stand together."""
        size = lambda code: F.get(needed, F.floor((code + F.lit(_SPAN // 2)) / F.lit(_SPAN)).cast("int"))
        return F.array_distinct(F.filter(found, lambda code, i: F.coalesce(F.get(found, i + size(code) - 1) == code, F.lit(False))))

    codes = _let(F.array_sort(codes), agreed)

    def tried(code):
        tpl = F.floor((code + F.lit(_SPAN // 2)) / F.lit(_SPAN)).cast("int")
        start = (code - tpl.cast("long") * F.lit(_SPAN)).cast("int")
        return F.struct(start.alias("start"), F.get(_templates(), tpl).alias("t"))

    def judged(x):
        form, start = x["t"]["words"], x["start"]
        aligned = F.size(F.filter(form, lambda w, i: F.coalesce(F.get(words, start + i) == w, F.lit(False))))
        keys = F.forall(x["t"]["phrases"], lambda p: (start + p["at"] >= 0) & (F.array_join(F.slice(words, F.greatest(start + p["at"] + 1, F.lit(1)), p["n"]), " ") == p["text"]))
        return F.struct(x["t"]["label"].alias("label"), F.when(keys, aligned / F.size(form)).alias("share"))

    return F.filter(F.transform(F.transform(codes, tried), judged), lambda x: F.coalesce(x["share"] >= least_share, F.lit(False)))


def scan(docs: DataFrame, least_share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each document row.

    A template is accepted if its key phrases stand where one beginning puts them and ``least_share`` of its words do; its
    greatest share is its score. Every beginning is tried at which the key phrases can stand, since they hold the indexed word.
    A base phrase alone scores 0.5; a file without any label 0. Labels are distinct, sorted and comma-joined, empty if
    none. Null texts have no words. Ties of IDF go to the smaller word. One pass counts documents by licence word (a row
    for each of a fixed vocabulary is shuffled and collected); a second does the rest within each row, so no text, word or
    posting is shuffled or written, and no document's size or frequency of copies matters to another's.
    """
    ranked = ranked_words(docs, text_col)
    cut = docs.select(F.col(id_col).alias("doc_id"), words_column(text_col).alias("words"))
    cut = cut.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.array_intersect(F.array(*map(F.lit, ranked)), "words").alias("lic"))
    none = F.array().cast("array<int>")
    found = [F.when(F.array_contains("lic", next(w for w in p.split() if w in (*_ANCHORS, "reserved", "license"))), _places(F.col("words"), p)).otherwise(none).alias(f"b{k}") for k, (p, _) in enumerate(BASE)]
    index, held_words = _anchors(ranked)
    top = F.array_intersect(F.array(*map(F.lit, sorted(index))), F.col("lic"))
    accepted = _let(top, lambda t: F.when(F.size(t) > 0, _accepted(F.col("words"), t, _postings(index), held_words, least_share)))
    held = cut.select("doc_id", "n_words", *found, accepted.alias("more"))

    every = F.flatten(F.array(*[F.col(f"b{k}") for k in range(len(BASE))]))
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)])))
    labels = F.array_sort(F.array_union(base, F.coalesce(F.col("more.label"), F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce(F.array_max("more.share"), F.lit(0.0)), F.when(F.size(every) > 0, 0.5).otherwise(0.0))
    return held.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"),
    )
