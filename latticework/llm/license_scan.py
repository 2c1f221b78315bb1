"""License scans: Dice coefficient over word bigrams, with Spark expressions only.

Method: a text is normalised (lower case, runs of ASCII characters that are
neither letters nor digits become spaces) and compared, as a whole and line by
line, to each template.  With A and B the sets of word bigrams, the Dice
coefficient 2 |A & B| / (|A| + |B|) can only reach the threshold t if
|A| / |B| lies between t / (2 - t) and (2 - t) / t, so sizes choose the
candidate templates before any intersection is made.

A notice that is wrapped over lines, or stands inside a longer line or text, is
found as a run of words: of each template whose bigrams a text holds to at
least t / (2 - t), the run of the highest coefficient from each place where a
stretch of the template's bigrams begins (starting earlier or inside a stretch
never gives more), over up to 2 |B| + 2 words.  A run is reported if it reaches
the threshold, unless the whole text does so, too, or it is part of a line that
does or overlaps a line of the same template; of runs that overlap the one of
the most common bigrams, weighted by its coefficient, stays.

Templates are rows of a small list that the caller gives; they become literals
of the plan, and their number is bounded by the caller's list.  Without a list
they are the short notices of TEMPLATES and then the full texts in `licenses`.

Defined results: null and empty texts match nothing; a unit of fewer than two
words has no bigrams; of equal coefficients the first template wins; repeated
rows match each; a null id stays null.  Very long texts are scanned whole, the
work of a text growing with its words; no rows give no rows.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

THRESHOLD = 0.8
# Short notices of well-known licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)
FULL_TEXTS = tuple((p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("licenses").glob("*.txt")))
_OTHER = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """Words of a normalised template."""
    return re.sub(_OTHER, " ", text.lower()).replace("\n", " ").split()


def bigrams_of(text: str) -> list[tuple[str, str]]:
    w = words_of(text)
    return sorted(set(zip(w, w[1:])))


def _templates(spark, templates) -> tuple[str, str]:
    """SQL of an array of (rank, license, n, bigrams) as a plan literal, and of all bigrams."""
    pairs = [(k, a, b) for k, (_, text) in enumerate(templates) for a, b in bigrams_of(text)]
    own = {}
    for k, h in spark.createDataFrame(pairs, "k int, a string, b string").select("k", F.xxhash64("a", "b")).collect():
        own.setdefault(k, []).append(h)
    rows = []
    for k, (name, _) in enumerate(templates):
        escaped = name.replace("\\", "\\\\").replace("'", "\\'")
        listed = ", ".join(f"{h}L" for h in own.get(k, []))
        rows.append(f"named_struct('rank', {k}, 'license', '{escaped}', 'n', {len(own.get(k, []))}, 'bigrams', cast(array({listed}) as array<bigint>))")
    return f"array({', '.join(rows)})", ", ".join(f"{h}L" for h in sorted({h for x in own.values() for h in x}))


_RUN = "struct<cost:double,dice:double,rank:int,start:int,end:int,license:string>"


def _runs(threshold: float, known: str) -> str:
    """SQL of the runs of words of a row (words, grams, templates, found) that reach the threshold."""
    low = threshold / (2 - threshold)
    # Of each word pair: place, the place of the pair before that is equal, hash.
    pairs = """transform(array(array_sort(transform(sequence(0, size(words[0]) - 2), i -> struct(xxhash64(words[0][i], words[0][i + 1]) as g, i as pos)))), s ->
        array_sort(transform(s, (x, k) -> struct(x.pos as pos, if(get(s, k - 1).g <=> x.g, get(s, k - 1).pos, -1) as prev, x.g as g))))[0]"""
    grown = "2D * (a.h + int(x.hit and x.prev < m.pos)) / (a.d + int(x.prev < m.pos) + t.n)"
    best = f"""aggregate(slice(marks, m.pos + 1, 2 * t.n + 1), named_struct('d', 0, 'h', 0, 'dice', 0D, 'common', 0, 'end', -1),
        (a, x) -> named_struct('d', a.d + int(x.prev < m.pos), 'h', a.h + int(x.hit and x.prev < m.pos), 'dice', greatest(a.dice, {grown}), 'common', if({grown} > a.dice, a.h + int(x.hit and x.prev < m.pos), a.common), 'end', if({grown} > a.dice, x.pos + 1, a.end)),
        a -> struct(-a.dice * a.common as cost, a.dice as dice, t.rank as rank, m.pos as start, a.end as end, t.license as license))"""
    of_template = f"""flatten(transform(array(transform(pairs, p -> struct(p.pos as pos, p.prev as prev, array_contains(t.bigrams, p.g) as hit))), marks ->
        filter(transform(filter(marks, (m, k) -> m.hit and not coalesce(get(marks, k - 1).hit, false)), m -> {best}), r -> r.dice >= {threshold}D)))"""
    # Words of the lines that reach the threshold themselves.
    length = "if(size(l) = 1 and l[0] = '', 0, size(l))"
    ends = f"aggregate(slice(words, 2, size(words)), array(0), (a, l) -> concat(a, array(element_at(a, -1) + {length})))"
    lines = f"transform(array({ends}), e -> transform(found, f -> struct(1D as cost, 0D as dice, f.best.rank as rank, e[f.unit] as start, e[f.unit + 1] - 1 as end, '' as license)))[0]"
    apart = f"""filter(aggregate(array_sort(flatten(flatten(transform(array({pairs}), pairs -> transform(near, t -> {of_template}))))), cast({lines} as array<{_RUN}>),
        (kept, r) -> if(exists(kept, o -> o.start <= r.end and r.start <= o.end and (o.cost < 0 or o.rank = r.rank or o.start <= r.start and r.end <= o.end)), kept, concat(kept, array(r)))), r -> r.cost < 0)"""
    near = f"""transform(array(filter(grams[0], g -> g in ({known}))), own ->
        filter(templates, t -> size(own) >= {low}D * t.n and size(array_intersect(own, t.bigrams)) >= {low}D * t.n))[0]"""
    none = f"cast(array() as array<{_RUN}>)"
    return f"if(exists(found, f -> f.unit = -1), {none}, transform(array({near}), near -> if(size(near) = 0, {none}, {apart}))[0])"


def scan(docs: DataFrame, templates=TEMPLATES + FULL_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit (line number from 0, -1 for the whole text, or -2 - k for a run from word k), license, rank and dice of every unit that reaches the threshold."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(bigrams_of(t)) for _, t in templates]
    fewest = max(1, int(low * min(sizes)))
    x = docs.where("text is not null").select("doc_id", F.regexp_replace(F.lower("text"), _OTHER, " ").alias("norm"))
    x = x.withColumn("units", F.concat(F.array("norm"), F.when(F.instr("norm", "\n") > 0, F.split("norm", "\n")).otherwise(F.array("norm"))))
    words = F.transform("units", lambda u: F.split(F.trim(F.regexp_replace(u, "[ \\n]+", " ")), " "))
    x = x.select("doc_id", words.alias("words"))

    def pairs(w):
        # Units with fewer words than any candidate needs get no bigrams.
        n = F.size(w)
        return F.when(n > fewest, F.array_distinct(F.transform(F.slice(w, 1, n - 1), lambda a, i: F.xxhash64(a, F.get(w, i + 1))))).otherwise(F.array().cast("array<bigint>"))

    literal, known = _templates(docs.sparkSession, templates)
    x = x.select("doc_id", "words", F.transform("words", pairs).alias("grams")).withColumn("templates", F.expr(literal))

    def best(g, unit):
        size = F.size(g)
        fits = F.filter("templates", lambda t: (size >= low * t["n"]) & (size <= high * t["n"]))
        dice = F.transform(
            fits,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(g, t["bigrams"])) / (size + t["n"])).alias("dice"), (-t["rank"]).alias("order"), t["rank"].alias("rank"), t["license"].alias("license")
            ),
        )
        return F.struct((unit - 1).alias("unit"), F.array_max(dice).alias("best"))

    found = F.filter(F.transform("grams", best), lambda m: F.coalesce(m["best"]["dice"] >= threshold, F.lit(False)))
    x = x.withColumn("found", found)
    runs = F.transform(F.expr(_runs(threshold, known)), lambda r: F.struct((-2 - r["start"]).alias("unit"), F.struct(r["dice"].alias("dice"), (-r["rank"]).alias("order"), r["rank"].alias("rank"), r["license"].alias("license")).alias("best")))
    x = x.select("doc_id", F.explode(F.concat("found", runs)).alias("m"))
    return x.select("doc_id", F.col("m.unit").cast("long").alias("unit"), F.col("m.best.license").alias("license"), F.col("m.best.rank").cast("long").alias("template"), F.round("m.best.dice", 6).alias("dice"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({k}, {quoted(n)}, {quoted(t)})" for k, (n, t) in enumerate(TEMPLATES))


_NORMAL = r"regexp_replace(lower({}), '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
ORACLE = rf"""
WITH t0 AS (SELECT * FROM (VALUES {_values()}) v(template, license, text)),
t1 AS (SELECT template, license, string_split(trim(regexp_replace({_NORMAL.format("text")}, '[ \n]+', ' ', 'g')), ' ') AS w FROM t0),
t AS (SELECT template, license, {_PAIRS} AS g FROM t1),
n AS (SELECT doc_id, {_NORMAL.format("text")} AS norm FROM documents WHERE text IS NOT NULL),
u0 AS (SELECT doc_id, -1 AS unit, norm AS u FROM n
  UNION ALL SELECT doc_id, unnest(range(len(string_split(norm, chr(10))))) AS unit, unnest(string_split(norm, chr(10))) AS u FROM n),
u1 AS (SELECT doc_id, unit, string_split(trim(regexp_replace(u, '[ \n]+', ' ', 'g')), ' ') AS w FROM u0),
u2 AS (SELECT doc_id, unit, {_PAIRS} AS g FROM u1 WHERE len(w) > 1),
m AS (SELECT doc_id, unit, license, template, 2.0 * len(list_intersect(u2.g, t.g)) / (len(u2.g) + len(t.g)) AS dice
  FROM u2 JOIN t ON len(u2.g) <= {(2 - THRESHOLD) / THRESHOLD} * len(t.g) AND len(u2.g) >= {THRESHOLD / (2 - THRESHOLD)} * len(t.g)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, template) AS r FROM m)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, license, CAST(template AS BIGINT) AS template, round(dice, 6) AS dice FROM b WHERE r = 1 AND dice >= {THRESHOLD}"""
