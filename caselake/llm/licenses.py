"""Licence scans: Dice coefficient over word bigrams against licence templates.

Text is normalised to lower-case runs of ASCII letters and digits. The units
compared are all spans of words, within a line and across lines, so every line and
whole text too. With A and B the sets of word
bigrams of a unit and a template, the coefficient is 2 |A and B| / (|A| + |B|); since
|A and B| is at most min(|A|, |B|), templates whose size isn't within
[t / (2 - t), (2 - t) / t] of the unit's can't reach a threshold t and are
pruned before anything is counted. A unit of one word has that word as its set.

A template's best span begins and ends with one of its own bigrams, the first
not met again and the last not met before in the span: cutting off anything else at an
end never lowers the coefficient. Spans are sought only for templates of which the text
holds t / (2 - t) of the bigrams, fewer can't reach t. The lines that match are
those that reach t themselves and those touched by the best spans that don't overlap.

Cases: a null, empty or wordless text matches nothing (license null, score 0, no
lines); ties go to the template listed first; a very long text is scanned
with memory for one document, each place by at most one span per bigram of a template; repeated rows give equal
results; empty tables give empty results; further columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, spread, table

THRESHOLD = 0.7

# The public wording of short licence statements and standard notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("All-rights-reserved", "All rights reserved."),
)

_TO_SPACE = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


def bigrams(words: list[bytes]) -> set:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(w,) for w in words}


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.names, self.threshold = [n for n, _ in templates], threshold
        sets = [bigrams(normal_words(t)) for _, t in templates]
        self.sets, self.sizes = sets, [len(s) for s in sets]
        self.where: dict = {}
        for k, s in enumerate(sets):
            for g in s:
                self.where.setdefault(g, []).append(k)
        ratio = threshold / (2 - threshold)
        self.least, self.most = min(self.sizes) * ratio, max(self.sizes) / ratio

    def best(self, words: list[bytes]) -> tuple[float, int] | None:
        """Highest coefficient of a unit, with the first template that has it."""
        if not words or len(words) - 1 > self.most and len(set(words)) > self.most + 1:
            return None  # at least one bigram fewer than distinct words: too large for every template
        own = bigrams(words)
        n, t = len(own), self.threshold
        if not self.least <= n <= self.most:
            return None
        shared = Counter(k for g in own & self.where.keys() for k in self.where[g] if t * (n + self.sizes[k]) <= 2 * min(n, self.sizes[k]))
        return max(((2 * c / (n + self.sizes[k]), -k) for k, c in shared.items() if 2 * c / (n + self.sizes[k]) >= t), default=None)

    def spans(self, words: list[bytes]) -> list[tuple[float, int, int, int]]:
        """(coefficient, -template, first word, last word) of each template's best span from each of its bigrams, if it reaches the threshold."""
        grams = list(zip(words, words[1:], strict=False))
        t, out = self.threshold, []
        present = set(grams) & self.where.keys()
        if not present:
            return out
        held = Counter(k for g in present for k in self.where[g])
        for k, count in held.items():
            size, own = self.sizes[k], self.sets[k]
            if count * (2 - t) < t * size:
                continue
            for p in [i for i, g in enumerate(grams) if g in own]:
                seen, shared, best = set(), 0, None
                for q in range(p, len(grams)):
                    g = grams[q]
                    if q > p and g == grams[p] or t * (len(seen) + size) > 2 * size:
                        break
                    if g in seen:
                        continue
                    seen.add(g)
                    if g in own:
                        shared += 1
                        score = 2 * shared / (len(seen) + size)
                        if score >= t and (best is None or score > best[0]):
                            best = (score, -k, p, q + 1)
                if best:
                    out.append(best)
        return out

    def scan(self, text: str | None) -> tuple[str | None, float, list[int]]:
        """Best licence of a text, its coefficient, and the lines that match any."""
        words = [normal_words(p) for p in (text or "").split("\n")]
        found = [self.best(w) for w in words]
        flat = [w for line in words for w in line]
        spans = sorted(self.spans(flat), key=lambda x: (-x[0], -x[1], x[2]))
        top = max([f for f in [*found, *((x[0], x[1]) for x in spans[:1])] if f], default=None)
        lines = {k for k, f in enumerate(found) if f}
        if spans:
            line_of = [k for k, line in enumerate(words) for _ in line]
            taken: list[tuple[int, int]] = []
            for _, _, a, b in spans:
                at = bisect_left(taken, (a, b))
                if (at == 0 or taken[at - 1][1] < a) and (at == len(taken) or b < taken[at][0]):
                    taken.insert(at, (a, b))
                    lines.update(line_of[a : b + 1])
        return (self.names[-top[1]] if top else None), (top[0] if top else 0.0), sorted(lines)


def scan_licenses(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with license, score and license_lines (places of matching lines, from 0)."""
    df = df.drop("license", "score", "license_lines")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(threshold=threshold)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = [scanner.scan(t) for t in field(part, text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.int32()))], names=[*part.schema.names, "license", "score", "license_lines"])

    return spread(df).mapInArrow(run, f"{fields}, license string, score double, license_lines array<int>")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return scan_licenses(docs).selectExpr("doc_id", "license", "round(score, 6) AS score", "CAST(size(license_lines) AS int) AS n_lines")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(n)}, {quote(t)})" for k, (n, t) in enumerate(TEMPLATES))
    words = "list_filter(string_split(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    grams = "list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"
    return f"""
WITH templates AS (SELECT k, name, {grams} AS g FROM (SELECT k, name, {words.format(x='t')} AS w FROM (VALUES {rows}) v(k, name, t))),
units AS (
  SELECT doc_id, i AS pos, {words.format(x='parts[i]')} AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
  UNION ALL SELECT doc_id, 0, {words.format(x='text')} FROM documents WHERE contains(text, chr(10))),
sets AS (SELECT doc_id, pos, {grams} AS g FROM units WHERE len(w) > 0),
grams AS (SELECT doc_id, pos, len(g) AS n, unnest(g) AS x FROM sets),
marks AS (SELECT k, len(g) AS n, unnest(g) AS x FROM templates),
hits AS (SELECT a.doc_id, a.pos, b.k, 2.0 * count(*) / (any_value(a.n) + any_value(b.n)) AS score FROM grams a JOIN marks b USING (x) GROUP BY 1, 2, 3 HAVING score >= {THRESHOLD}),
best AS (SELECT doc_id, arg_max(k, score - k * 1e-9) AS k, max(score) AS score, count(DISTINCT pos) FILTER (pos > 0) AS n_lines FROM hits GROUP BY 1)
SELECT d.doc_id, t.name AS license, round(coalesce(b.score, CAST(0 AS DOUBLE)), 6) AS score, CAST(coalesce(b.n_lines, 0) AS INTEGER) AS n_lines
FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN templates t ON t.k = b.k"""


OP4_SQL = _sql()
