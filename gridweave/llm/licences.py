"""Licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences and lines and normalised (lower case, runs of other characters
than letters and digits become one space); runs of lines of one sentence are looked up among
known licence sentences, so that they are found however their text is wrapped; the
identifiers found, in the order of the text, are matched against ordered rules.  A rule
takes the identifiers it matches, so that a shorter rule further down doesn't see them.
Sentences and rules come from whole licence texts (``from_texts``; a DataFrame of texts does
as well) and from a table of single sentences.  All known sentences are one pattern, a tree
of words, so that a place in a text is tried once, however many sentences there are.  All of
it is one projection: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import TEXTS

# Licence sentences as their licences word them, and their identifiers.
SENTENCES = {
    "APACHE2_LICENSED": "Licensed under the Apache License, Version 2.0.",
    "APACHE2_THE_LICENSE": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "APACHE2_HEADER": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "APACHE2_MAY_NOT_USE": "you may not use this file except in compliance with the License.",
    "APACHE2_OBTAIN": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "APACHE2_AS_IS": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "APACHE2_SEE": "See the License for the specific language governing permissions and limitations under the License.",
    "MIT_RELEASED": "Released under the MIT License.",
    "MIT_LICENSED": "Licensed under the MIT License.",
    "MIT_TITLE": "The MIT License (MIT)",
    "MIT_TITLE_SHORT": "MIT License",
    "MIT_GRANT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT_NOTICE": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT_AS_IS": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "BSD_REDISTRIBUTION": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD_SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD_BINARY": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD_NAME": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD_LICENSED": "Released under the BSD License.",
    "GPL3_WORK": "This work is licensed under the GNU General Public License, version 3.",
    "GPL3_LICENSED": "Licensed under the GNU General Public License, version 3.",
    "GPL2_WORK": "This work is licensed under the GNU General Public License, version 2.",
    "GPL_FREE": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL_HOPE": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL_SEE": "See the GNU General Public License for more details.",
    "LGPL3_WORK": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL2_FORM": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC_BY_4": "Licensed under CC BY 4.0.",
    "CC_BY_SA_4": "Licensed under CC BY-SA 4.0.",
    "CC_BY_NC_4": "Licensed under CC BY-NC 4.0.",
    "CC_BY_ND_4": "Licensed under CC BY-ND 4.0.",
    "CC_BY_WORK": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC_BY_NC_WORK": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "PUBLIC_DOMAIN": "This work is in the public domain.",
    "UNLICENSE": "This is free and unencumbered software released into the public domain.",
    "RESERVED": "All rights reserved.",
}
#: Rules in the order of matching: licence, and the identifiers that must follow one another.
RULES = (
    ("Apache-2.0", ("APACHE2_HEADER", "APACHE2_OBTAIN", "APACHE2_AS_IS", "APACHE2_SEE")),
    ("Apache-2.0", ("APACHE2_THE_LICENSE", "APACHE2_MAY_NOT_USE", "APACHE2_OBTAIN", "APACHE2_AS_IS", "APACHE2_SEE")),
    ("BSD-3-Clause", ("BSD_REDISTRIBUTION", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME")),
    ("BSD-2-Clause", ("BSD_REDISTRIBUTION", "BSD_SOURCE", "BSD_BINARY")),
    ("MIT", ("MIT_TITLE", "MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS")),
    ("GPL-3.0-or-later", ("GPL_FREE", "GPL_HOPE", "GPL_SEE")),
    ("GPL-3.0-or-later", ("GPL_FREE",)),
    ("Apache-2.0", ("APACHE2_HEADER",)),
    ("Apache-2.0", ("APACHE2_LICENSED",)),
    ("MIT", ("MIT_GRANT",)),
    ("MIT", ("MIT_RELEASED",)),
    ("MIT", ("MIT_LICENSED",)),
    ("MIT", ("MIT_TITLE",)),
    ("MIT", ("MIT_TITLE_SHORT",)),
    ("BSD", ("BSD_LICENSED",)),
    ("GPL-3.0", ("GPL3_WORK",)),
    ("GPL-3.0", ("GPL3_LICENSED",)),
    ("GPL-2.0", ("GPL2_WORK",)),
    ("LGPL-3.0", ("LGPL3_WORK",)),
    ("MPL-2.0", ("MPL2_FORM",)),
    ("CC-BY-4.0", ("CC_BY_4",)),
    ("CC-BY-4.0", ("CC_BY_WORK",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_4",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_4",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_WORK",)),
    ("CC-BY-ND-4.0", ("CC_BY_ND_4",)),
    ("Unlicense", ("UNLICENSE",)),
    ("Public-Domain", ("PUBLIC_DOMAIN",)),
    ("All-Rights-Reserved", ("RESERVED",)),
)
#: A known sentence is cut at line ends, and at . ! ? and white space.
ENDS = r"([.!?])[ \t]+"


def normalised(sentence: str) -> str:
    """The form under which a sentence is looked up; the same as the column expression's."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate({c: c + 32 for c in range(65, 91)})).strip()


def _pieces(text: str) -> list[str]:
    """Known texts may hold several sentences, as MPL's does: each piece is looked up by itself."""
    return [n for s in re.sub(ENDS, r"\1\n", text).split("\n") if (n := normalised(s))]


def lookup(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentence to identifier; of a text of several sentences, the longest stands for it."""
    return {max(_pieces(text), key=len): name for name, text in sentences.items()}


#: A sentence of a licence text with fewer words is no sign of it.
LEAST_WORDS = 5


def from_texts(texts: dict[str, str], sentences: dict[str, str], rules) -> tuple[dict[str, str], tuple]:
    """Normalised sentences by identifier, and rules, of whole licence texts, and of single sentences behind them.

    A licence's rule is the order of its sentences; longer rules come first.  A sentence
    that has a name in ``sentences`` keeps it; any other is named by its digest, so that
    licences with a sentence in common share it.
    """
    known = lookup(sentences)
    made = []
    for name, text in texts.items():
        pieces = [p for p in _pieces(text) if len(p.split()) >= LEAST_WORDS]
        for p in pieces:
            known.setdefault(p, "L" + hashlib.sha256(p.encode()).hexdigest()[:12])
        made.append((name, tuple(known[p] for p in pieces)))
    made.sort(key=lambda r: (-len(r[1]), r[0]))
    return known, (*made, *rules)


def texts_of(table: DataFrame, licence: str = "licence", text: str = "text", most: int = 5000) -> dict[str, str]:
    """Licence texts from a table of at most ``most`` rows; a larger one isn't a table of licences."""
    rows = table.select(licence, text).filter(F.col(licence).isNotNull() & F.col(text).isNotNull()).orderBy(licence, text).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} licence texts")
    return {f"{r[0]}": r[1] for r in rows}


KNOWN, ALL_RULES = from_texts(TEXTS, SENTENCES, RULES)


#: A capital stands for what can't be in the lower text: S for the end of a sentence, M around a match.
_BREAKS = r"([.!?])(?:[ \t]+|\r?\n)"


def _pattern(known) -> str:
    """Known sentences from the start of a line or sentence to the end of one, the longest first.

    Between two words is a space or one line end; before an address also empty lines, as
    licences set it apart.  Comment marks at the start of a line are spaces by then.
    Sentences that begin alike share that part of the pattern.
    """
    tree: dict = {}
    for sentence in sorted(known):
        node = tree
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def body(node: dict) -> str:
        out = ""
        while len(node) == 1 and "" not in node:
            (word, node), = node.items()
            out += gap(word) + word
        rest = [gap(w) + w + body(n) for w, n in node.items() if w]
        if not rest:
            return out
        # a longer sentence goes before one that it covers
        return f"{out}(?:{'|'.join([*rest, *([''] if '' in node else [])])})"

    gap = lambda word: "[ \n]+" if word.startswith("http") else "(?: ?\n ?| )"
    first = "|".join(word + body(node) for word, node in tree.items())
    return f"(?<![a-z0-9 ]) ?({first}) ?(?![a-z0-9 ])"


def found_column(text: Column, known: dict[str, str] = KNOWN) -> Column:
    """(number of the first line or sentence, identifier) of each known sentence, in order; null text: none."""
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(F.regexp_replace(low, _BREAKS, "$1S"), "[^a-z0-9S\n]+", " ")
    # the odd parts are the matches; one that was wrapped leaves its line ends behind it, so that the index of a part between ends is its number
    parts = F.split(F.regexp_replace(plain, _pattern(known), "M$1M"), "M", -1)
    inner = lambda p: F.repeat(F.lit("\n"), F.length(p) - F.length(F.translate(p, "\n", "")))
    marked = F.transform(parts, lambda p, k: F.when(k % 2 == 1, F.concat(F.lit("M"), F.regexp_replace(p, "[ \n]+", " "), inner(p))).otherwise(p))
    numbered = F.transform(F.split(F.array_join(marked, ""), "[S\n]", -1), lambda x, k: F.struct(k.alias("at"), x.alias("id")))
    hits = F.filter(numbered, lambda x: F.startswith(x["id"], F.lit("M")))
    one = lambda x: F.struct(x["at"].alias("at"), F.element_at(names, F.substring(x["id"], 2, 1 << 30)).alias("id"))
    return F.when(F.size(parts) > 1, F.transform(hits, one)).otherwise(F.array().cast("array<struct<at:int,id:string>>"))


def licence_scan(docs: DataFrame, *, known: dict[str, str] = KNOWN, rules=ALL_RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with found (number of the sentence or line from 0, identifier), sentence_ids and licences.

    A known sentence that covers others is found in their place.
    licences holds each licence once, in the order of the rules that matched.  Null or empty
    text, or one without known sentences: empty arrays.  Every row comes out once, repeated
    rows too; columns with the added names are replaced, all others pass through.
    """
    docs = docs.drop("found", "sentence_ids", "licences")
    out = docs.withColumn("found", found_column(F.col(text_col), known))
    out = out.withColumn("sentence_ids", F.col("found.id"))
    chain = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in rules])
    start = F.struct(chain.alias("rest"), F.array().cast("array<string>").alias("names"))
    step = lambda s, r: F.struct(F.replace(s["rest"], r["ids"], F.lit("|")).alias("rest"), F.when(F.contains(s["rest"], r["ids"]), F.array_append(s["names"], r["name"])).otherwise(s["names"]).alias("names"))
    matched = F.aggregate(steps, start, step, lambda s: F.array_distinct(s["names"]))
    return out.withColumn("licences", F.when(F.size("found") == 0, F.array().cast("array<string>")).otherwise(matched))


def op1_licence_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = licence_scan(docs)
    joined = lambda c: F.array_join(c, ",")
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), joined("sentence_ids").alias("sentence_ids"), joined(F.transform("found", lambda x: x["at"].cast("string"))).alias("sentence_numbers"), joined("licences").alias("licences"))


def _sql() -> str:
    known = ", ".join(f"'{s}': '{i}'" for s, i in KNOWN.items())
    rest = "array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '')"
    chain, names = [f"r0 AS (SELECT *, {rest} AS s0 FROM f)"], []
    for k, (_, ids) in enumerate(ALL_RULES):
        key = "".join(f"<{i}>" for i in ids)
        chain.append(f"r{k + 1} AS (SELECT *, replace(s{k}, '{key}', '|') AS s{k + 1} FROM r{k})")
        names.append(f"CASE WHEN contains(s{k}, '{key}') THEN {k} END")
    shown: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(ALL_RULES):
        shown.setdefault(name, []).append(k)
    firsts = ", ".join("{'k': least(" + ", ".join(names[k] for k in ks) + "), 'n': '" + name + "'}" for name, ks in shown.items())
    return f"""
WITH c AS (SELECT doc_id, list_transform(string_split(regexp_replace(translate(regexp_replace(coalesce(text, ''), '{ENDS}', '\\1' || chr(10), 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda s: trim(s)) AS s FROM documents),
k AS (SELECT MAP {{{known}}} AS m),
g AS (SELECT doc_id, list_filter(list_transform(s, lambda x, i: {{'at': i - 1, 'id': m[x]}}), lambda x: x.id IS NOT NULL) AS found FROM c, k),
f AS (SELECT *, list_transform(found, lambda x: x.id) AS ids FROM g),
{", ".join(chain)}
SELECT doc_id, len(found) AS n_found, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_transform(found, lambda x: x.at::VARCHAR), ',') AS sentence_numbers,
  coalesce(array_to_string(list_transform(list_sort(list_filter([{firsts}], lambda x: x.k IS NOT NULL)), lambda x: x.n), ','), '') AS licences FROM r{len(ALL_RULES)}
"""


OP1_SQL = _sql()
