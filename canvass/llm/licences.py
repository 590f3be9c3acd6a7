"""License scans (operator 4): Dice coefficient over word bigrams, with size bounds.

Each line, paragraph and whole text is compared with the templates of licences as a bag of word
bigrams. The coefficient of bags of a and b bigrams is at most 2 min(a, b) / (a + b), so a template
whose size is out of bounds is never compared. Windows over the whole text, from a template's size up
to its upper bound, find the notices inside longer lines and paragraphs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import freeing, small_batches, table
from canvass.llm.licence_texts import NOTICES, TEXTS

THRESHOLD = 0.8
WORD = r"[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*"
#: Lines without a word part paragraphs.
GAP = r"\n[^A-Za-z0-9]*\n"

#: Texts by which licences are declared (fixed values); a parameter of the operator.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
     '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Whole licences and further notices, which the SQL below doesn't have.
VARIANTS: tuple[tuple[str, str], ...] = TEXTS + NOTICES


class Scanner:
    """Templates sorted by size; ``best`` compares a list of words with those in bounds, ``inside`` its windows."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES + VARIANTS, threshold: float = THRESHOLD):
        self.threshold, self.find, self.gap = threshold, re.compile(WORD).findall, re.compile(GAP)
        bags = [(name, Counter(pairwise(x.lower() for x in self.find(text)))) for name, text in templates]
        self.bags = sorted(((sum(bag.values()), name, bag) for name, bag in bags), key=lambda t: t[:2])
        self.sizes = [n for n, _, _ in self.bags]
        self.bound = threshold / (2 - threshold)
        self.having: dict[tuple[str, str], list[int]] = {}
        for i, (_, _, bag) in enumerate(self.bags):
            for pair in bag:
                self.having.setdefault(pair, []).append(i)

    def inside(self, words: list[str]) -> tuple[float, str] | None:
        """The same over all windows of a template's size or more; shorter ones lose what tells licences apart.

        The best window begins and ends with bigrams of the template or has just its size.
        """
        pairs, hits, found = list(pairwise(w.lower() for w in words)), {}, None
        for at, pair in enumerate(pairs):
            for i in self.having.get(pair, ()):
                hits.setdefault(i, []).append(at)
        for i, places in hits.items():
            size, name, template = self.bags[i]
            need, longest = math.ceil(self.threshold * size - 1e-9), math.floor(size / self.bound + 1e-9)
            if len(pairs) < size:
                continue
            for first in range(len(places) - need + 1):
                begin = places[first]
                if places[first + need - 1] - begin >= longest:
                    continue
                left, common = dict(template), 0
                for at in places[first:]:
                    if at - begin >= longest:
                        break
                    if left[pairs[at]]:
                        left[pairs[at]] -= 1
                        common += 1
                        dice = 2 * common / (max(at - begin + 1, size) + size)
                        if dice >= self.threshold and (found is None or (-dice, name) < (-found[0], found[1])):
                            found = dice, name
        return found

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """Highest coefficient at or above the threshold, with the first licence by name among equals."""
        n = len(words) - 1
        if n < 1:
            return None
        slack = 1e-9
        lo, hi = bisect_left(self.sizes, n * self.bound - slack), bisect_right(self.sizes, n / self.bound + slack)
        if lo >= hi:
            return None
        bag, found = Counter(pairwise(w.lower() for w in words)), None
        for size, name, template in self.bags[lo:hi]:
            dice = 2 * sum(min(bag[p], c) for p, c in template.items() if p in bag) / (n + size)
            if dice >= self.threshold and (found is None or (-dice, name) < (-found[0], found[1])):
                found = dice, name
        return found

    def scan(self, text: str) -> tuple[str | None, float | None, int]:
        lines = [self.find(x) for x in text.split("\n")]
        found = [x for x in map(self.best, lines) if x]
        n = len(found)
        whole = [w for x in lines for w in x]
        if len(lines) > 1:
            some = [whole] if len(whole) * self.bound <= self.sizes[-1] + 1 else []
            parts = self.gap.split(text)
            if len(parts) > 1 or not some:
                some += [self.find(p) for p in parts]
            found += [x for x in map(self.best, some) if x]
        found += [x for x in [self.inside(whole)] if x]
        if not found:
            return None, None, 0
        dice, name = min(found, key=lambda x: (-x[0], x[1]))
        return name, dice, n


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + VARIANTS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, n_lines`` of every row: the best template over its lines, paragraphs, whole text and windows.

    ``license`` and ``dice`` are null where nothing reaches the threshold; ``n_lines`` counts the whole
    lines that do. Ties go to the first licence by name. Null, empty and blank texts have none; texts of any length are
    read whole. Repeated rows and null ids keep their rows; other columns of ``docs`` are not read; an empty table gives an
    empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, threshold)
        for x in batches:
            found = [scanner.scan(t or "") for t in x.pop("text")]
            more = pd.DataFrame(found, columns=["license", "dice", "n_lines"], index=x.index)
            yield pd.concat([x, more.astype({"dice": "float64", "n_lines": "int64"})], axis=1)

    schema = docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_lines")).schema
    for f in schema:
        f.nullable = True
    return docs.select("doc_id", "text").mapInPandas(freeing(run), schema)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    return ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))


#: In SQL, without windows and ``VARIANTS``: segments, sizes in bounds, bags of bigrams, and the best of each document.
OP4_SQL = rf"""
WITH templates(tid, license, body) AS (VALUES {_values()}),
twords AS (SELECT tid, license, regexp_extract_all(lower(body), '{WORD}') AS w FROM templates),
tbags AS (
  SELECT tid, license, len(w) - 1 AS size, g, count(*) AS c
  FROM (SELECT tid, license, w, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM twords) GROUP BY ALL
), tsizes AS (SELECT DISTINCT tid, license, size FROM tbags),
segments AS (
  SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS s FROM documents
  UNION ALL SELECT doc_id, 'part', unnest(string_split_regex(text, '{GAP}')) FROM documents
  UNION ALL SELECT doc_id, 'text', text FROM documents
), numbered AS (
  SELECT row_number() OVER () AS sid, doc_id, kind, regexp_extract_all(s, '{WORD}') AS w FROM segments
), near AS (
  SELECT n.sid, n.doc_id, n.kind, n.w, t.tid, t.license, t.size
  FROM numbered n JOIN tsizes t ON len(n.w) > 1
   AND 2 * least(len(n.w) - 1, t.size) >= {THRESHOLD} * (len(n.w) - 1 + t.size) - 1e-6
), sbags AS (
  SELECT sid, g, count(*) AS c
  FROM (SELECT sid, unnest(list_transform(range(1, len(w)), lambda i: lower(w[i] || ' ' || w[i + 1]))) AS g
        FROM (SELECT DISTINCT sid, w FROM near)) GROUP BY ALL
), scored AS (
  SELECT n.sid, n.doc_id, n.kind, n.license, 2 * sum(least(s.c, b.c))::DOUBLE / (any_value(len(n.w)) - 1 + n.size) AS dice
  FROM near n JOIN sbags s ON s.sid = n.sid JOIN tbags b ON b.tid = n.tid AND b.g = s.g
  GROUP BY n.sid, n.doc_id, n.kind, n.license, n.tid, n.size
), kept AS (SELECT * FROM scored WHERE dice >= {THRESHOLD}),
best AS (
  SELECT doc_id, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) AS r FROM kept
), lines AS (SELECT doc_id, count(DISTINCT sid) AS n FROM kept WHERE kind = 'line' GROUP BY doc_id)
SELECT d.doc_id, b.license, b.dice, coalesce(l.n, 0)::BIGINT AS n_lines
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.r = 1 LEFT JOIN lines l ON l.doc_id = d.doc_id
"""
