import random
import re

import pytest
from pyspark.sql import functions as F

from fieldspark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text):
    words, places, labels = words_of(text), [], set()
    for label, phrase in licenses.BASE:
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def texts():
    rng = random.Random(4)
    out = [None, "", "MIT", "cc by nc", "CC-BY-NC cc by nc", "under THE mit license under the mit license", "é under the mit license2", "under the mİt license Åcc by nc", "cc by nK", "apache license,\nversion 2.0", "x " * 5000 + "cc by nc"]
    vocabulary = "under the mit license apache version 2 cc by nc é 4.0 -".split()
    return out + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(150)] + ["cc by nc"] * 2


def test_base_columns_equal_brute_force(spark):
    rows = [(k % 150 if k % 9 else None, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1)).repartition(3)
    out = licenses.scan(docs).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str)
    assert got == sorted(((k, *slow(t)) for k, t in rows), key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)


#: Text, labels.
CASES = [
    ("Licensed, under the GNU General Public License (the GPL), version 3", "gpl-3"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
    ("Licensed under the GNU GPL, or the general public may use the version", ""),
    ("You may use it under the terms of the GNU General Public License, version 3.", "gpl-3"),
    ("You may use it under the terms of the GNU General Public License, version 2.", "gpl-2"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lgpl"),
    ("under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "lgpl"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl-3"),
    ("Licensed under the GNU Affero General Public License version 3", "agpl-3"),
    ("Licensed under the GNU Lesser General Public License version 3", "lgpl"),
    ("Licensed under the GNU General Public License v2", "gpl-2"),
    ("it is licensed under the GNU General Public License.", "gpl"),
    ("under the terms of the GNU Affero General Public License", "agpl"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
    ("licensed under a Creative Commons Attribution Non-Commercial No Derivatives License", "cc-by-nc-nd"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Redistribution and use in source and/or binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0bsd"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including", "mit"),
    ("a work licensed under the GNU General Public License, version 3, and some parts of it under the MIT License.", "gpl-3,mit"),
    ("some under the terms of the GNU General Public License, version 2; others under the terms of the GNU Lesser General Public License", "gpl-2,lgpl"),
    ("under terms the of General GNU License Public the version 2", ""),
    ("version 2 of the GNU General Public License licensed the under", ""),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
]


def test_labels_of_licences_that_look_alike(spark):
    longest = "word " * 30_000
    rows = [(k, t) for k, (t, _) in enumerate(CASES)] + [(100 + k, f"{longest}. {t} and {longest}") for k, (t, _) in enumerate(CASES[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("template", F.lit("x")).repartition(3)
    out = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {k: out[k].labels for k in range(len(CASES))} == {k: want for k, (_, want) in enumerate(CASES)}
    assert [out[100 + k].labels for k in range(3)] == [want for _, want in CASES[:3]]
    assert out[100].spans[0].first == 30_000 and out[0].spans[0].first == 0


def test_edits_beyond_what_is_allowed(spark):
    passage = next(p for p in licenses.PASSAGES if p.label == "mit").text.split()
    rng, rows = random.Random(6), []
    for k in range(60):
        w = list(passage)
        for _ in range(k % 16):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice([[], ["edited"]])
        rows.append((k, "before it " + " ".join(w) + " after"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licenses.scan(docs, keep=("doc_id", "text")).collect():
        kept = 1 - least_edits(passage, words_of(r.text)) / len(passage)
        assert r.score <= kept + 1e-9
        if "free of charge" in r.text and kept < 0.7:
            assert r.labels == ""
        if "free of charge" in r.text and kept >= 0.9:
            assert r.labels == "mit"


def least_edits(passage, words):
    """The edits that turn the passage into some run of the words."""
    row = [0] * (len(words) + 1)
    for i, p in enumerate(passage, 1):
        diagonal, row[0] = row[0], i
        for j, w in enumerate(words, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (p != w))
    return min(row)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "cc by nc", "x")], "doc_id long, text string, score string")
    assert licenses.scan(docs).first().n_base == 1
    with pytest.raises(ValueError):
        licenses.scan(docs, keep=("doc_id", "score"))


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
