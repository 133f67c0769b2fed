"""Licence scans by the Dice coefficient of word bigrams: lines, whole texts and windows of words against licence templates."""

from __future__ import annotations

import re
from functools import reduce
from importlib import resources

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_out

DICE = 0.8
#: Public licence notices, by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


#: Licences whose full texts, in the folder texts, are compared with windows beside the notices.
TEXTS = ("Apache-2.0", "BSD-3-Clause", "GPL-3.0", "ISC", "MIT", "MPL-2.0", "Unlicense")


def full_texts() -> tuple:
    folder = resources.files(__package__).joinpath("texts")
    return tuple((name, folder.joinpath(f"{name}.txt").read_text()) for name in TEXTS)


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:], strict=False)))


def anchors(templates: list[list[str]], dice: float = DICE) -> list[str]:
    """Words of which every match of a template has at least one: bigrams without them are fewer than a match must share.

    Long words come first, as they are rarer in other texts, and those that serve most templates.
    """
    out: list[str] = []
    words = {w for t in templates for b in t for w in b.split()}
    serves = {w: sum(any(w in b.split() for b in t) for t in templates) for w in words}
    order = sorted(words, key=lambda w: (-min(len(w), 7), -serves[w] if len(w) > 4 else serves[w], w))
    for t in sorted(templates, key=len):
        needed = dice / (2 - dice) * len(t) - 1e-9  # shared bigrams of the smallest match
        free = lambda t=t: sum(not set(b.split()) & set(out) for b in t)
        for w in order:
            if free() < needed:
                break
            if w not in out and any(w in b.split() for b in t):
                out.append(w)
    return out


def bigrams(text: Column) -> Column:
    """Different bigrams of a text's words: runs of letters and digits, lower-cased."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def text_anchors(own: list[str], dice: float = DICE) -> list[str]:
    """Words of which every match of one long template has at least one: those in most of its bigrams, words of five letters first."""
    out: list[str] = []
    words = {w: sum(w in b.split() for b in own) for w in {w for b in own for w in b.split()}}
    order = sorted(words, key=lambda w: (len(w) < 5, -words[w], w))
    while sum(not set(b.split()) & set(out) for b in own) >= dice / (2 - dice) * len(own) - 1e-9:
        out.append(order[len(out)])
    return out


def _contains_any(text: Column, words: list[str]) -> Column:
    """Whether text holds one of the words; lower-cased once, not for each word."""
    has = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.coalesce(F.get(F.transform(F.array(F.lower(text)), has), F.lit(0)), F.lit(False))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def windows(docs: DataFrame, dice: float, templates: tuple, texts: tuple) -> DataFrame:
    """doc_id, key (hash of the text), first and last line, license, template, dice of windows of the words of a text.

    A window has as many words as its template and begins at any bigram of it, wherever lines break.  Of windows that overlap the
    one that shares most bigrams stays.  Starts whose window has too few bigrams of the template, counted with repeats, are not
    compared: they can't match.
    """
    named, known = [name for name, _ in (*templates, *texts)], []
    for _, text in (*templates, *texts):
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        own = template_bigrams(text)
        hashes = [h - (1 << 64) if (h := xxhash.xxh64_intdigest(b.encode(), 42)) >> 63 else h for b in own]  # as F.xxhash64
        known.append((own, hashes, len(words) - 1, max(1, -int(-(dice / (2 - dice) * len(own) - 1e-9) // 1))))
    literal = lambda hs: F.split(F.lit(",".join(map(str, hs))), ",").cast("array<bigint>")  # noqa: E731  folded into a literal
    ws = F.col("ws")
    # texts are cut into words once, and only those with an anchor of any template are held against each template's
    asked = [(0, anchors([x[0] for x in known[: len(templates)]], dice))] if templates else []
    asked += [(2 * need, text_anchors(own, dice)) for own, _, _, need in known[len(templates) :]]
    has = lambda words: F.arrays_overlap(ws, F.array(*map(F.lit, words)))
    likely = reduce(lambda a, b: a | b, [(F.length("text") >= least) & has(words) for least, words in asked])
    every = list(dict.fromkeys(w for _, words in asked for w in words))
    pairs = F.zip_with(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    # explode keeps Catalyst from evaluating an array once for each use of it
    cut = some.select("row", "doc_id", "text", F.explode(F.array(_words(F.col("text")))).alias("ws")).where(has(every)).where(likely)
    hashed = cut.select("row", "doc_id", "text", F.explode(F.array(pairs)).alias("b"))
    hits = hashed.select("row", "doc_id", "text", "b", F.explode(F.array(F.array_intersect(literal({h for x in known for h in x[1]}), "b"))).alias("hits"))
    hits = hits.where(F.size("hits") >= min(x[3] for x in known))
    each = [F.when((F.size("hits") >= need) & (F.size(F.array_intersect(literal(hs), "hits")) >= need), F.struct(F.lit(k).alias("k"), F.lit(size).alias("size"), F.lit(need).alias("need"), literal(hs).alias("own"))) for k, (_, hs, size, need) in enumerate(known)]
    met = hits.select("row", "doc_id", "text", "b", F.inline(F.array_compact(F.array(*each))))
    places = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: F.array_contains("own", F.get("b", i)))
    met = met.select("*", F.explode(F.array(places)).alias("at"))
    starts = F.filter("at", lambda p, j: F.coalesce(F.get("at", j + F.col("need") - 1) - p < F.col("size"), F.lit(False)))
    window = lambda p: F.slice("b", p + 1, F.col("size"))
    both = F.transform(starts, lambda p: F.struct(p.alias("p"), F.size(F.array_intersect(window(p), "own")).alias("both"), F.size(F.array_distinct(window(p))).alias("n")))
    found = met.select("row", "doc_id", "text", "k", "size", F.size("own").alias("m"), F.inline(both))
    score = 2.0 * F.col("both") / (F.col("n") + F.col("m"))
    item = F.struct("both", score.alias("dice"), (-F.col("k")).alias("k"), (-F.col("p")).alias("p"), "size")
    listed = found.where(score >= dice).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.reverse(F.array_sort(F.collect_list(item))).alias("items"))
    kind = "array<struct<both:int,dice:double,k:int,p:int,size:int>>"
    meets = lambda a, x: (-a["p"] < -x["p"] + x["size"]) & (-x["p"] < -a["p"] + a["size"])
    kept = F.aggregate("items", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda a: meets(a, x)), acc).otherwise(F.concat(acc, F.array(x)).cast(kind)))
    lines = F.flatten(F.transform(F.split("text", "\n"), lambda line, i: F.array_repeat(i, F.size(_words(line)))))
    out = listed.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.array(lines)).alias("lines"), F.inline(kept))
    name = F.get(F.array(*map(F.lit, named)), -F.col("k"))
    last = F.least(F.size("lines") - 1, F.col("size") - F.col("p"))
    return out.select("doc_id", "key", F.get("lines", -F.col("p")).alias("first"), F.get("lines", last).alias("last"), name.alias("license"), (-F.col("k")).alias("template"), F.round("dice", 9).alias("dice"))


def scan(docs: DataFrame, dice: float = DICE, templates: tuple = TEMPLATES, texts: tuple | None = None) -> DataFrame:
    """doc_id, line, license, template, dice: the best template of each line, of each text of several lines (line -1), and of windows.

    A window of words that begins in line n has line -2 - n.  It is a row where neither the whole text nor a line it touches has a row
    of its licence, and it isn't inside one line that has a row.  Windows are compared with the full texts too (numbers after the
    templates').  Only matches of `dice` or more are rows; ties go to the template that comes first.  Null and empty texts match nothing.
    Templates whose size rules out the coefficient are not compared.
    """
    known = [(name, template_bigrams(text)) for name, text in templates]
    words = anchors([b for _, b in known], dice)

    def likely(text: Column) -> Column:
        return _contains_any(text, words)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(likely(F.col("text")))
    # a text and its lines, in one scan; a text of one line is that line
    each = F.concat(F.when(F.contains("text", F.lit("\n")), F.array("text")).otherwise(F.array(F.lit(None))), F.split("text", "\n"))
    units = some.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(each).alias("at", "unit")).select("doc_id", "key", (F.col("at") - 1).alias("line"), "unit")
    # explode keeps Catalyst from evaluating the bigrams once for each use of them
    sets = units.where(likely(F.col("unit"))).select("doc_id", "key", "line", F.explode(F.array(bigrams(F.col("unit")))).alias("b"))
    n = F.size("b")
    scores = []
    for k, (_, own) in enumerate(known):
        score = 2.0 * F.size(F.array_intersect("b", F.array(*map(F.lit, own)))) / (n + len(own))
        fits = (n >= dice / (2 - dice) * len(own) - 1e-9) & (n <= (2 - dice) / dice * len(own) + 1e-9)
        scores.append(F.when(fits, F.struct(score.alias("dice"), F.lit(-k).alias("k"))))
    top = F.array(F.array_max(F.array_compact(F.array(*scores))))
    best = sets.select("doc_id", "key", "line", F.explode(F.filter(top, lambda s: s["dice"] >= dice)).alias("best"))
    names = reduce(lambda c, k: c.when(F.col("best.k") == -k, known[k][0]), range(1, len(known)), F.when(F.col("best.k") == 0, known[0][0]))
    best = write_out(best.select("doc_id", "key", "line", names.alias("license"), (-F.col("best.k")).alias("template"), F.round("best.dice", 9).alias("dice")), "license-lines")
    own = best.select(F.col("doc_id").alias("id"), "key", "line", "license").groupBy("id", "key").agg(F.collect_set(F.struct("line", "license")).alias("rows"))
    more = windows(docs, dice, templates, full_texts() if texts is None else texts).alias("w").join(own.alias("o"), F.col("w.key").eqNullSafe(F.col("o.key")) & F.col("w.doc_id").eqNullSafe(F.col("o.id")), "left")
    touched = lambda r: (r["line"] == -1) | r["line"].between(F.col("first"), F.col("last"))
    told = F.exists("rows", lambda r: (touched(r) & (r["license"] == F.col("w.license"))) | ((r["line"] == F.col("first")) & (F.col("first") == F.col("last"))))
    more = more.where(~F.coalesce(told, F.lit(False))).select("w.doc_id", (-2 - F.col("first")).alias("line"), "w.license", "w.template", "w.dice")
    return best.drop("key").union(more)


def oracle_sql(dice: float = DICE, templates: tuple = TEMPLATES) -> str:
    """DuckDB SQL that compares every unit with every template."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({k}, {quoted(name)}, [{', '.join(map(quoted, template_bigrams(text)))}])" for k, (name, text) in enumerate(templates))
    return rf"""
WITH t(template, license, own) AS (VALUES
  {rows}),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS unit FROM l UNION ALL SELECT doc_id, -1, text FROM l WHERE len(ls) > 1),
w AS (SELECT doc_id, line, list_filter(string_split(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM u),
b AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS b FROM w),
s AS (SELECT doc_id, line, license, template, 2.0 * len(list_intersect(b, own)) / (len(b) + len(own)) AS d FROM b, t WHERE len(b) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY d DESC, template) AS k FROM s WHERE d >= {dice})
SELECT doc_id, CAST(line AS INT) AS line, license, CAST(template AS INT) AS template, round(d, 9) AS dice FROM r WHERE k = 1"""
