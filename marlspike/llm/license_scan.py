"""Licence notices by the Dice coefficient over word bigrams, in SQL functions alone.

A document's units are its lines, and its paragraphs of several lines (paragraphs end at
empty lines). Units and templates are normalised alike: lower case, everything but letters
and digits as one space. A unit of a bigrams can only reach a coefficient t with templates of
``a t / (2 - t)`` to ``a (2 - t) / t`` bigrams; others are not compared. Templates are
constants, so the scan needs no join and no shuffle: each row is decided where it is read.

A notice can share its unit with other text, so runs of words within a unit (windows) are
compared too. A unit or window that reaches t holds so many of a template's n bigrams that
one of its ``n - t n / (2 - t) + 1`` rarest is among them (its anchors); texts without an
anchor, which one expression finds, have none. Bigrams that are not the template's only
lower the coefficient at a window's ends, so windows start and end with one that is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
NOT_WORD = r"[^\p{L}\p{N}\n]+"
LINE_END = " ?\n ?"
PARAGRAPH_END = "( ?\n){2,} ?"

#: Words that make a poor anchor, as do single characters and numbers. This only decides how many texts are looked at.
COMMON = set("a all an and any are at be by can for from have in is it of on or that the this to under use will with without you your".split())

# Notices and opening paragraphs of common licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "Apache-2.0 warranty": """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause header": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:""",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
    "GPL warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "ISC permission": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT notice": "Released under the MIT License.",
    "MIT permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions:""",
    "MIT warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    import re

    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(grams: list[str], threshold: float) -> list[str]:
    """The rarest bigrams of a template, enough that each window that reaches ``threshold`` has one."""
    order = sorted(grams, key=lambda g: (sum(w in COMMON or len(w) == 1 or w.isdigit() for w in g.split()), -len(g), g))
    return order[: len(grams) - _needed(len(grams), threshold) + 1]


def _needed(n: int, threshold: float) -> int:
    """Bigrams that a unit or window shares with a template of ``n`` at the least, where it reaches ``threshold``."""
    return max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9))


def _trie(words: list[str]) -> str:
    """A pattern of the words that decides each character once; a space in a word is a run of spaces and line ends."""
    after: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        after.setdefault(w[:1], []).append(w[1:])
    rest = [("[ \n]+" if c == " " else c) + _trie(tails) for c, tails in after.items() if c]
    if not rest:
        return ""
    group = rest[0] if len(rest) == 1 else "(?:" + "|".join(rest) + ")"
    return group if "" not in after else "(?:" + group + ")?"


def _any_of(grams: list[str]) -> str:
    """A pattern of texts that hold one of the bigrams, over line ends too."""
    heads = "".join(sorted({g[0] for g in grams}))
    return rf"(?:^|[ \n])(?=[{heads}])" + f"(?:{_trie(grams)})" + r"(?:[ \n]|$)"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def _pairs(words: Column) -> Column:
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def _best_window(pairs: Column, line: Column, several: Column, template: Column) -> Column:
    """``less, name`` of a template's best window in a unit, or null; ``line`` is each word's line, ``several`` whether there are more than one.

    In a unit of several lines, the window has to run over a line end: others belong to their line.
    """
    n, need, most, known = (template[c] for c in ("n", "need", "most", "grams"))

    def scored(start: Column, end: Column) -> Column:
        held = F.slice(pairs, start + 1, end - start + 1)
        less = -2.0 * F.size(F.array_intersect(held, known)) / (F.size(F.array_distinct(held)) + n)
        return F.struct(less.alias("less"), (F.get(line, start) != F.get(line, end + 1)).alias("over"))

    def windows(at: Column) -> Column:
        # only where enough of the template's bigrams stand close together
        first = F.filter(F.sequence(F.lit(1), F.size(at) - need + 1), lambda j: F.get(at, j + (need - 2)) - F.get(at, j - 1) < most)
        ends = lambda j: F.filter(F.slice(at, j + (need - 1), most - need + 1), lambda e: e - F.get(at, j - 1) < most)
        return F.flatten(F.transform(first, lambda j: F.transform(ends(j), lambda e: scored(F.get(at, j - 1), e))))

    at = F.filter(F.transform(pairs, lambda g, i: F.when(F.array_contains(known, g), i)), lambda i: i.isNotNull())
    best = _let(at, lambda at: F.when(F.size(at) >= need, F.array_min(windows(at))))
    return _let(best, lambda b: F.when(b.isNotNull() & (~several | b["over"]), F.struct(b["less"].alias("less"), template["name"].alias("name"))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, license, similarity, n_units``.

    ``license`` is the template with the highest coefficient of any unit (the first name of
    equals) and ``similarity`` that coefficient; both are null where no unit reaches
    ``threshold``. ``n_units`` counts the units that reach it. A unit's coefficient is the
    highest of its own and those of its windows: runs of words with no more bigrams, repeats
    included, than a unit that can reach ``threshold`` has different ones. In a paragraph,
    the best window of a template counts only if it runs over a line end. Null and empty
    texts and units of fewer than two words match nothing. Repeated rows give equal rows;
    other columns are not read; an empty table gives an empty result.
    """
    known = [(name, grams) for name, text in sorted((templates or TEMPLATES).items()) if (grams := template_bigrams(text))]
    if not known:
        raise ValueError("no template has two words")
    words = lambda own: F.array(*map(F.lit, own))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.lit(len(g)).alias("n"), words(g).alias("grams"), words(anchors(g, threshold)).alias("anchors"),
                F.lit(_needed(len(g), threshold)).alias("need"), F.lit(math.floor(len(g) * (2 - threshold) / threshold + 1e-9)).alias("most"),
            )
            for name, g in known
        ]
    )

    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), NOT_WORD, " ")
    lines = F.split(F.col("plain"), LINE_END)
    paragraphs = F.filter(F.split(F.col("plain"), PARAGRAPH_END), lambda x: x.contains("\n"))

    def best(grams: Column) -> Column:
        n = F.size(grams)
        close = F.filter(F.col("templates"), lambda t: (t["n"] >= n * (threshold / (2 - threshold))) & (t["n"] <= n * ((2 - threshold) / threshold)))
        scored = F.transform(
            close,
            lambda t: F.struct((-2.0 * F.size(F.array_intersect(grams, t["grams"])) / (n + t["n"])).alias("less"), t["name"].alias("name")),
        )
        return F.array_min(scored)

    # the units of texts with an anchor, as lists of lines
    rows = lambda u: F.filter(F.transform(F.split(u, LINE_END), lambda x: F.btrim(x)), lambda x: x != "")
    some_anchor = _any_of([a for _, g in known for a in anchors(g, threshold)])
    # a unit without an anchor has none within either
    units = F.filter(F.concat(lines, paragraphs), lambda u: u.rlike(some_anchor))
    pieces = F.filter(F.transform(units, rows), lambda p: F.size(p) > 0)

    def best_in(piece: Column) -> Column:
        def of(u: Column) -> Column:
            near = F.filter(F.col("templates"), lambda t: F.arrays_overlap(u["pairs"], t["anchors"]))
            inner = F.transform(near, lambda t: _best_window(u["pairs"], u["line"], u["several"], t))
            return F.array_min(F.concat(F.array(_let(F.array_distinct(u["pairs"]), best)), inner))

        line = F.flatten(F.transform(piece, lambda x, i: F.transform(F.split(x, " "), lambda _: i)))
        text = F.array_join(piece, " ")
        return _let(F.struct(text.alias("text"), _pairs(F.split(text, " ")).alias("pairs"), line.alias("line"), (F.size(piece) > 1).alias("several")), of)

    anchored = F.col("plain").rlike(some_anchor)
    found = F.coalesce(F.transform("pieces", best_in), F.array().cast("array<struct<less:double,name:string>>"))
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), plain.alias("plain"))
        .select("doc_id", "plain", anchored.alias("anchored"))
        .select("doc_id", F.when(F.col("anchored"), pieces).alias("pieces"), entries.alias("templates"))
        .select("doc_id", F.filter(found, lambda x: x.isNotNull() & (x["less"] <= -threshold)).alias("found"))
        .select(
            "doc_id",
            F.array_min("found")["name"].alias("license"),
            (-F.array_min("found")["less"]).alias("similarity"),
            F.size("found").cast("long").alias("n_units"),
        )
    )


def oracle_sql(threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> str:
    """The same as DuckDB SQL over ``documents``, for units as a whole: notices that share their line or paragraph are not found."""
    rows = ", ".join(
        "('{}', [{}])".format(name.replace("'", "''"), ", ".join(f"'{g}'" for g in template_bigrams(text))) for name, text in sorted((templates or TEMPLATES).items())
    )
    return rf"""
        WITH template(name, grams) AS (VALUES {rows}),
        plain AS (
            SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents
        ), unit AS (
            SELECT doc_id, unnest(list_concat(
                list_transform(regexp_split_to_array(t, ' ?\n ?'), lambda x: trim(x)),
                list_transform(list_filter(regexp_split_to_array(t, '( ?\n){{2,}} ?'), lambda x: contains(x, chr(10))),
                               lambda x: trim(regexp_replace(x, ' ?\n ?', ' ', 'g'))))) AS u
            FROM plain
        ), word AS (
            SELECT doc_id, string_split(u, ' ') AS w FROM unit WHERE contains(u, ' ')
        ), gram AS (
            SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM word
        ), near AS (
            SELECT doc_id, row_number() OVER () AS k, g FROM gram
        ), scored AS (
            SELECT doc_id, k, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
            FROM near JOIN template ON len(grams) BETWEEN len(g) * {threshold} / (2 - {threshold}) - 1 AND len(g) * (2 - {threshold}) / {threshold} + 1
        ), hit AS (
            SELECT doc_id, k, max(dice) AS dice, arg_min(name, (-dice, name)) AS name FROM scored WHERE dice >= {threshold} GROUP BY doc_id, k
        ), best AS (
            SELECT doc_id, count(*) AS n_units, max(dice) AS similarity, arg_min(name, (-dice, name)) AS license FROM hit GROUP BY doc_id
        )
        SELECT d.doc_id, license, similarity, coalesce(n_units, 0) AS n_units FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id
    """
