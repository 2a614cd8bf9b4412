"""Licence scans by diagonal voting, in DataFrame functions alone.

Every text's word 3-grams are hashed and joined to the positions that their hashes have in the templates. A match votes
for the diagonal (position in the text less position in the template); votes are summed by text, template and diagonal.
Words left out or put in tell neighbouring diagonals apart, so the diagonal of most votes takes those within ``slack`` of it,
and the words from where the first matched template word puts the template's start to where the last one puts its end, or up
to ``slack`` words further where that keeps more, are its span: the template's length at most, and thrice the slack.

A span is then verified word by word. The edit distance between the template and the span, in words and so in order, must
leave enough of the template; the words that tell the licence from its kin (its version, "affero", "sharealike") must stand
in the span, and those of its kin must not. Where spans of different labels overlap, the one that keeps most words counts.
A base phrase counts only if one diagonal holds all of it.

The templates are a table of fixed size, so it is broadcast. Their hashes also stand as a literal set in the scan: a
3-gram that no template has is dropped there, before rows are made of it. Rows of one text then meet in one task, a row
for each match with the words around it, as many as the longest span has on each side, whatever the text's length.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

K = 3
#: Runs of digits, a to z, and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label, phrase; found only where all words stand consecutively.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


class Passage(NamedTuple):
    """A licence's wording; phrases that a span of it must hold, and words that it must not."""

    label: str
    text: str
    marks: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


def _gnu() -> list[Passage]:
    kin, out = ("lesser", "library", "affero"), []
    #: Label without version, the words of its name, versions.
    names = [("gpl", "", ("2", "3")), ("lgpl", "lesser", ("2 1", "3")), ("lgpl", "library", ("2",)), ("agpl", "affero", ("3",))]
    wordings = [
        "licensed under the {name} version {v}", "licensed under the {name} v{v}", "under the terms of the {name} version {v}",
        "under the terms of the {name} as published by the free software foundation either version {v} of the license or at your option any later version",
        "under the terms of the {name} as published by the free software foundation version {v} of the license",
    ]
    for label, word, versions in names:
        name = " ".join(f"gnu {word} general public license".split())
        without = tuple(k for k in kin if k != word)
        for w, v in product(wordings, versions):
            mark = f"v{v}" if " v{v}" in w else f"version {v}"
            out.append(Passage(label if label == "lgpl" else f"{label}-{v}", w.format(name=name, v=v), (mark, "general public license"), without))
        out += [Passage(label, f"{w} {name}", (name,), without) for w in ("licensed under the", "under the terms of the")]
    return out


def _creative_commons() -> list[Passage]:
    #: Part of the label, its spellings.
    words = {"nc": ("noncommercial", "non commercial"), "nd": ("noderivatives", "no derivatives"), "sa": ("sharealike", "share alike")}
    kin = ("noncommercial", "commercial", "noderivatives", "derivatives", "sharealike", "alike")
    out = []
    for parts in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for spelt in sorted({tuple(words[p][k] for p in parts) for k in (0, 1)}):
            name = " ".join(("attribution", *spelt))
            without = tuple(k for k in kin if k not in name.split())
            out += [Passage("-".join(("cc-by", *parts)), w.format(name=name), spelt, without) for w in ("licensed under a creative commons {name} license", "creative commons {name} 4 0 international license")]
    return out


#: Found where an edited copy of the text stands.
PASSAGES = [
    *_gnu(),
    *_creative_commons(),
    Passage("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), ("1",)),
    Passage("mpl-2", "this source code form is subject to the terms of the mozilla public license version 2 0", ("mozilla public license",), ("1",)),
    Passage("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and", "binary forms")),
    Passage("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Passage("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    Passage("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("this permission notice appear in all copies",)),
    Passage("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby granted",)),
    Passage("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("free of charge",)),
    Passage("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial portions",)),
    Passage("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    Passage("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    Passage("public-domain", "this is free and unencumbered software released into the public domain", ("public domain",)),
    Passage("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]


def lowered(text: Column) -> Column:
    """text with A-Z in lower case. Of other characters only the
    Kelvin sign and I with a dot have a lower case with an ASCII letter; these become another letter first."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for letter in ("\N{KELVIN SIGN}", "\N{LATIN CAPITAL LETTER I WITH DOT ABOVE}"):
        text = F.replace(text, F.lit(letter), F.lit("\N{LATIN SMALL LETTER KRA}"))
    return F.lower(text)


def _coded(words: Column, known: Column) -> Column:
    """The words as one text with a character for each: its place among the known words, or '@'."""
    return F.array_join(F.transform(words, lambda w: F.char(F.lit(64) + F.array_position(known, w))), "")


def templates(spark: SparkSession, base: list[tuple[str, str]], passages: list[Passage]) -> DataFrame:
    """(template, label, exact, n, words, known, code, marks, without): a row for each template."""
    rows = [(True, Passage(*x)) for x in base] + [(False, Passage(*x)) for x in passages]
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    parts = [F.struct(F.lit(k).alias("template"), F.lit(x.label).alias("label"), F.lit(exact).alias("exact"), F.split(F.lit(x.text), " ").alias("words"), texts(x.marks).alias("marks"), texts(x.without).alias("without")) for k, (exact, x) in enumerate(rows)]
    table = spark.range(1).select(F.inline(F.array(*parts))).withColumn("known", F.array_distinct("words"))
    return table.select("template", "label", "exact", F.size("words").alias("n"), "words", "known", _coded(F.col("words"), F.col("known")).alias("code"), "marks", "without")


def _hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(K)])


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), base: list[tuple[str, str]] = BASE, passages: list[Passage] = PASSAGES, enough: float = 0.75, slack: int = 6) -> DataFrame:
    """The columns ``keep`` and n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    One row for each row of docs, repeated rows and null ids included; an empty table gives no rows. n_base: the places of
    all base phrases; first_word, last_word: the smallest and largest word number (from 0) at which one starts, else null.
    base_labels and labels: distinct, sorted, comma-joined, '' without any. score: the largest part of a template that a
    span keeps, whether it counts or not. spans: array<struct<label, first, last, cover>> of what counts, by word number.
    Null and empty texts have no words; long texts are read whole. enough: the part of a passage that a span must keep; slack:
    by how much diagonals of a span differ from its strongest. Columns of docs that are not in ``keep`` may have any name;
    one in ``keep`` that has one of the new names is an error. Passages have 60 different words at most.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    if clash := {c.lower() for c in keep} & set(new):
        raise ValueError(f"keep has names of new columns: {sorted(clash)}")
    spark = docs.sparkSession
    table = templates(spark, base, passages)
    reach = max(len(x[1].split()) for x in (*base, *passages)) + 3 * slack
    grams = table.select("template", "exact", "n", "words", F.explode(F.sequence(F.lit(0), F.col("n") - K)).alias("tpos"))
    grams = grams.select("template", "exact", (F.col("n") - (K - 1)).alias("grams"), "tpos", F.array_join(F.slice("words", F.col("tpos") + 1, K), " ").alias("gram"), _hash(F.col("words"), F.col("tpos")).alias("hash"))
    known = [r.hash for r in grams.select("hash").distinct().collect()]  # some hundred numbers
    row, words, at = "__row", "__words", "__at"
    carried_names = [f"__keep{k}" for k in range(len(keep))]
    text = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, carried_names)], F.monotonically_increasing_id().alias(row), F.regexp_extract_all(lowered(F.col(text_col)), F.lit(WORD), F.lit(0)).alias(words))
    places = F.sequence(F.lit(0), F.size(words) - K)
    places = F.when(F.size(words) >= K, F.filter(places, lambda i: _hash(F.col(words), i).isin(known)))
    text = text.select(*carried_names, row, F.size(words).alias("n_words"), words, F.explode_outer(places).alias(at))
    place = F.coalesce(at, F.lit(0))
    around = F.when(F.col(at).isNotNull(), F.struct(F.greatest(F.lit(0), F.col(at) - reach).alias("start"), F.slice(words, F.greatest(F.lit(0), place - reach) + 1, 2 * reach + 1).alias("words")))
    text = text.select(*carried_names, row, "n_words", at, _hash(F.col(words), F.col(at)).alias("hash"), F.array_join(F.slice(words, place + 1, K), " ").alias("gram"), around.alias("around"))
    rows = text.join(F.broadcast(grams), ["hash", "gram"], "left").repartition(row)
    carried = [F.first(c).alias(c) for c in (*carried_names, "n_words")]
    votes = rows.groupBy(row, "template", (F.col(at) - F.col("tpos")).alias("diagonal")).agg(
        *carried, F.first("exact").alias("exact"), F.first("grams").alias("grams"), F.count("tpos").alias("votes"), F.min("tpos").alias("head"), F.max("tpos").alias("tail"), F.min(F.struct(at, "around"))["around"].alias("around")
    )
    near = W.partitionBy(row, "template").orderBy("diagonal").rangeBetween(-slack, slack)
    strength = F.struct("votes", -F.col("diagonal"))
    head = F.min(F.struct("head", -F.col("votes"), "diagonal")).over(near)["diagonal"]
    tail = F.max(F.struct("tail", "votes", "diagonal")).over(near)["diagonal"]
    own = F.col("exact")
    spans = votes.select("*", (strength == F.max(strength).over(near)).alias("strongest"), F.when(own, F.col("diagonal")).otherwise(head).alias("first"), F.when(own, F.col("diagonal")).otherwise(tail).alias("last"))
    spans = spans.filter(F.col("template").isNull() | own | F.col("strongest")).join(F.broadcast(table.drop("exact", "words")), "template", "left")
    first = F.greatest("first", F.lit(0))
    spans = spans.withColumn("last", F.greatest(F.least(F.col("last") + F.col("n"), "n_words") - 1, first)).withColumn("first", first)
    most = F.when(own, 0).otherwise(F.least(F.lit(slack), F.col("n_words") - 1 - F.col("last")))
    words_to = lambda end: F.slice("around.words", F.col("first") - F.col("around.start") + 1, end - F.col("first") + 1)
    coded = _coded(words_to(F.col("last") + most), F.col("known"))
    edits = lambda m: F.levenshtein(F.substring(F.col("coded"), F.lit(1), F.col("last") - F.col("first") + 1 + m), F.col("code"))
    spans = spans.withColumn("coded", coded).withColumn("edits", F.array_min(F.transform(F.sequence(F.lit(0), most), lambda m: F.struct(edits(m).alias("n"), (-m).alias("further")))))
    spans = spans.withColumn("last", F.col("last") - F.col("edits.further")).withColumn("span", words_to(F.col("last")))
    spans = spans.withColumn("kept", F.when(~own, F.greatest(F.lit(0), F.col("n") - F.col("edits.n"))))
    spans = spans.withColumn("cover", F.when(own, F.col("votes") / F.col("grams")).otherwise(F.col("kept") / F.col("n")))
    joined = F.concat(F.lit(" "), F.array_join("span", " "), F.lit(" "))
    marked = F.forall("marks", lambda m: F.contains(joined, F.concat(F.lit(" "), m, F.lit(" ")))) & ~F.arrays_overlap("span", "without")
    spans = spans.withColumn("valid", ~own & (F.col("cover") >= enough) & marked)
    around_it = W.partitionBy(row).orderBy("first").rangeBetween(-reach, reach)
    rivals = F.collect_list(F.when(F.col("valid"), F.struct("first", "last", "label", "kept", "template"))).over(around_it)
    better = lambda x: (x["label"] != F.col("label")) & (x["first"] <= F.col("last")) & (x["last"] >= F.col("first")) & ((x["kept"] > F.col("kept")) | ((x["kept"] == F.col("kept")) & (x["template"] < F.col("template"))))
    spans = spans.withColumn("rivals", rivals).withColumn("wins", F.col("valid") & ~F.exists("rivals", better))
    whole = own & (F.col("cover") == 1)
    counts = whole | F.col("wins")
    found = F.when(counts, F.struct("label", "first", "last", "cover"))
    join = lambda on: F.array_join(F.sort_array(F.collect_set(F.when(on, F.col("label")))), ",")
    out = spans.groupBy(row).agg(
        *carried, F.count_if(whole).alias("n_base"), F.min(F.when(whole, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(whole, F.col("first"))).cast("long").alias("last_word"),
        join(whole).alias("base_labels"), join(counts).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"), F.array_sort(F.collect_list(found)).alias("spans"),
    )
    return out.select(*[F.col(n).alias(c) for n, c in zip(carried_names, keep)], F.col("n_words").cast("long").alias("n_words"), *new[1:])
