"""Licence scans: lines and whole texts held against licence templates.

Method: normalised text (lower-cased runs of letters and digits) is compared with each template by the Dice coefficient
over the sets of word bigrams, 2|A and B| / (|A| + |B|). Size bounds prune first: the coefficient is at most
2 min / (|A| + |B|), so only templates with |A| between t|B| / (2 - t) and its converse are compared. A document's units
are its lines and its whole text. A licence that none of these matches is then looked for in windows of consecutive
words of the text, over line ends, so that wrapped notices and sentences inside a paragraph are found: every window of at
most |A| (2 - t) / t bigrams that begins and ends with a bigram of the template A (others lower the coefficient) is
compared, in documents that hold at least the |A| t / (2 - t) of its bigrams without which no window can match. Lines and
whole texts come first: where one matches, license and dice are theirs, and windows only add names to licenses.
Only DataFrame functions are used; the templates are a short fixed list in the plan.

Defined cases: null and empty texts have no licence. Units of fewer than two words have no bigrams and match nothing.
Ties in the coefficient go to the licence name that sorts first. Repeated rows and null ids give rows like others. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

THRESHOLD = 0.8

# Short notices and grant texts of public licences, as their publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def normal(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _hash(a: str, b: str) -> int:
    """What F.xxhash64(a, b) gives, as a signed long."""
    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def _templates(templates: list[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    out = []
    for name, text in templates:
        w = normal(text)
        out.append((name, sorted({_hash(*p) for p in zip(w, w[1:])})))
    return out


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, licenses): the best match, and all matching names, sorted and joined by commas."""
    known = [t for t in _templates(templates) if t[1]]
    grams = lambda w: F.when(F.size(w) > 1, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))).otherwise(F.array().cast("array<bigint>"))
    low, high = (min(len(g) for _, g in known) * threshold / (2 - threshold), max(len(g) for _, g in known) * (2 - threshold) / threshold) if known else (1, 0)

    def best(g):
        """Matches of one unit's bigrams: only templates whose size is within the bounds are intersected."""
        n = F.size(g)
        return F.array(*[
            F.when((n >= len(t) * threshold / (2 - threshold)) & (n <= len(t) * (2 - threshold) / threshold), F.struct((-2.0 * F.size(F.array_intersect(g, F.lit(t))) / (n + len(t))).alias("score"), F.lit(name).alias("name")))
            for name, t in known
        ])

    def windows(w, found):
        """Matches of windows of the words w, for the licences that are not among the names found."""
        bound = lambda x, f: F.flatten(F.transform(F.array(x), f))  # noqa: E731  x is computed once
        none = F.array().cast("array<struct<score:double,name:string>>")
        every = sorted({h for _, t in known for h in t})
        least = min(math.ceil(len(t) * threshold / (2 - threshold) - 1e-9) for _, t in known)

        def of(g, at, name, t):
            few, many = math.ceil(len(t) * threshold / (2 - threshold) - 1e-9), math.floor(len(t) * (2 - threshold) / threshold + 1e-9)
            score = lambda b: F.struct((-2.0 * F.size(F.array_intersect(b, F.lit(t))) / (F.size(b) + len(t))).alias("score"), F.lit(name).alias("name"))
            here = lambda p: F.flatten(F.transform(p, lambda i: F.transform(F.filter(p, lambda j: (j - i >= few - 1) & (j - i < many)), lambda j: bound_one(F.array_distinct(F.slice(g, i + 1, j - i + 1)), score))))
            best = lambda p: F.filter(F.array(F.array_min(here(p))), lambda m: m["score"] <= -threshold)
            return bound(F.filter(at, lambda i: F.get(g, i).isin(t)), lambda p: F.when(F.size(p) >= few, best(p)).otherwise(none))

        bound_one = lambda x, f: F.get(F.transform(F.array(x), f), 0)

        def each(g, at, held):
            return F.flatten(F.array(*[
                F.when((F.size(F.array_intersect(held, F.lit(t))) >= len(t) * threshold / (2 - threshold) - 1e-9) & ~F.array_contains(found, name), of(g, at, name, t)).otherwise(none)
                for name, t in known
            ]))

        def of_known(g, at):
            return bound(F.array_distinct(F.transform(at, lambda i: F.get(g, i))), lambda held: F.when(F.size(held) >= least, each(g, at, held)).otherwise(none))

        def of_grams(g):
            return bound(F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.get(g, i).isin(every)), lambda at: F.when(F.size(at) >= least, of_known(g, at)).otherwise(none))

        all_grams = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) > 1, bound(all_grams, of_grams)).otherwise(none)

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), words_of)
    # all words are at hand before bigrams are made of a unit; repeated words make fewer bigrams, never more
    def both(u, w):
        """(hits of lines and the whole text, hits of windows)"""
        units = F.concat(u, F.when(F.size(u) > 1, F.array(w)).otherwise(F.array().cast("array<array<string>>")))
        fit = F.filter(F.transform(F.filter(units, lambda x: F.size(x) > low), grams), lambda g: (F.size(g) >= low) & (F.size(g) <= high))
        hits = F.filter(F.flatten(F.transform(fit, best)), lambda m: m.isNotNull() & (m["score"] <= -threshold))
        return F.transform(F.array(hits), lambda h: F.struct(h.alias("hits"), windows(w, F.transform(h, lambda m: m["name"])).alias("more")))

    found = F.flatten(F.transform(F.array(lines), lambda u: F.flatten(F.transform(F.array(F.flatten(u)), lambda w: both(u, w)))))
    none = F.array().cast("array<struct<score:double,name:string>>")
    found = F.get(found, 0) if known else F.struct(none.alias("hits"), none.alias("more"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    top = F.coalesce(F.array_min("found.hits"), F.array_min("found.more"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat("found.hits", "found.more"), lambda m: m["name"]))), ",")
    return out.select("doc_id", top["name"].alias("license"), (-top["score"]).alias("dice"), names.alias("licenses"))


def _values() -> str:
    rows = []
    for name, text in TEMPLATES:
        w = normal(text)
        rows.append(f"('{name}', [{', '.join(repr(f'{a} {b}') for a, b in sorted(set(zip(w, w[1:]))))}])")
    return ", ".join(rows)


SQL = f"""
with t(name, g) as (values {_values()}),
l as (select doc_id, row_number() over () as k, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: list_filter(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) as ls from documents),
u as (select doc_id, k, unnest(list_append(ls, flatten(ls))) as w from l),
g as (select doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from u where len(w) > 1),
m as (select k, name, 2.0::double * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) as dice from g join t on len(g.g) between len(t.g) * 0.8 / 1.2 and len(t.g) * 1.2 / 0.8),
b as (select k, name, max(dice) as dice from m where dice >= 0.8 group by all),
r as (select k, arg_min(name, (-dice, name)) as license, max(dice) as dice, string_agg(name, ',' order by name) as licenses from b group by k)
select doc_id, license, dice, coalesce(licenses, '') as licenses from l left join r using (k)
"""
