"""License scan by patience alignment.

A template and a stretch of text are aligned as words: equal words at both ends
match; of the rest, words that occur once in both are anchors; the longest
increasing subsequence of their places is kept, and the gaps between are aligned in
the same way. Coverage is the share of the template's words that matched.

A text is a candidate for a template only if it holds enough of its words, counted
with multiplicity, to reach the asked coverage. A copy with that coverage may lack m
words, so of any m + 1 places of the template it matches one at least: the stretches
lie around every occurrence of the words at the m + 1 places whose words are rarest in
that text. A stretch with too few template words to reach the coverage is not aligned.
Beside stretches already taken the search goes on with what lies between them. A copy
may have half the template's length and four words inserted on either side of a seed.
Texts are scanned whole, where they lie; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import texts_of
from .common import add_columns

WORD = re.compile(r"[a-z0-9]+")

#: License notices as they are commonly written.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by piles of patience."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text word, template word) pairs, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        kept = [anchors[i] for i in increasing([x for x, _ in anchors])]
        for x, y in kept:
            todo.append((a, x, c, y))
            out.append((x, y))
            a, c = x + 1, y + 1
        if kept:
            todo.append((a, b, c, d))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.templates = [(name, WORD.findall(text.lower())) for name, text in sorted(templates.items())]
        self.templates = [(name, words, Counter(words)) for name, words in self.templates if words]
        self.coverage = coverage
        self.vocabulary = frozenset(w for _, words, _ in self.templates for w in words)
        # so many different words at least, if all repeated ones match
        self.needed = min((ceil(coverage * len(words)) - len(words) + len(count) for _, words, count in self.templates), default=0)

    def spans(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last), without overlaps: of
        overlapping stretches the one with most matched words stays."""
        words = WORD.findall(text.lower())
        present = self.vocabulary.intersection(words)
        if not present or len(present) < self.needed:
            return []
        places: dict[str, list[int]] = {w: [] for w in present}
        for i, w in enumerate(words):
            if w in present:
                places[w].append(i)
        searches = []
        for number, (_, template, count) in enumerate(self.templates):
            need = max(1, ceil(self.coverage * len(template) - 1e-9))
            if sum(min(n, len(places.get(w, ()))) for w, n in count.items()) < need:
                continue
            # any copy matches one of so many places, whichever words it lacks
            seeds = sorted(range(len(template)), key=lambda j: (len(places.get(template[j], ())), j))[: len(template) - need + 1]
            starts = sorted({p - j for j in seeds for p in places.get(template[j], ())})
            total = [0, *accumulate(w in count for w in words)]
            searches.append((number, need, starts, total))
        taken: list[tuple[str, float, int, int]] = []
        free = [(0, len(words))]
        while free:
            found = [f for number, need, starts, total in searches for a, b in free for f in self._stretches(words, number, need, starts, total, a, b)]
            new = []
            for _, name, share, a, b in sorted(found, key=lambda f: (-f[0], f[3] - f[4], f[2], f[1])):
                if all(b <= x or a >= y for _, _, x, y in new):
                    new.append((name, share, a, b))
            taken += new
            # what is left of the parts that had a stretch
            ends = sorted((a, b) for _, _, a, b in new)
            rest = []
            for x, y in free:
                own = [(a, b) for a, b in ends if x <= a and b <= y]
                if own:
                    bounds = [x, *[e for pair in own for e in pair], y]
                    rest += [(a, b) for a, b in zip(bounds[::2], bounds[1::2], strict=True) if a < b]
            free = rest
        return sorted(taken, key=lambda t: t[2])

    def _stretches(self, words: list[str], number: int, need: int, starts: list[int], total: list[int], low: int, high: int) -> Iterator[tuple[int, str, float, int, int]]:
        """Stretches of words low..high that reach the coverage of a template, around
        its assumed ``starts``: (matched words, name, share, first, after)."""
        name, template, count = self.templates[number]
        size = len(template)
        slack = 4 + size // 2
        # with room for insertions, and without: there two copies on end keep apart
        for start in starts[bisect_left(starts, low - size) : bisect_left(starts, high)]:
            for room in (0, slack):
                first, after = max(low, start - room), min(high, start + size + room)
                if after - first < need or total[after] - total[first] < need:
                    continue
                here = Counter(words[first:after])
                if sum(min(n, here[w]) for w, n in count.items()) < need:
                    continue
                pairs = densest(align(words[first:after], template))
                if len(pairs) >= need:
                    yield len(pairs), name, len(pairs) / size, first + pairs[0][0], first + pairs[-1][0] + 1


def densest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Drop matches at either end that lie further away in the text than the template
    allows: chance words of the text around."""
    while len(pairs) > 1 and pairs[1][0] - pairs[0][0] > 2 + (pairs[1][1] - pairs[0][1]) * 2:
        pairs = pairs[1:]
    while len(pairs) > 1 and pairs[-1][0] - pairs[-2][0] > 2 + (pairs[-1][1] - pairs[-2][1]) * 2:
        pairs = pairs[:-1]
    return pairs


def scan(df: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``licenses`` (comma-joined names, sorted, each once), ``n_spans``,
    ``coverage`` (largest, 0 without a span) and ``spans`` (``name:first-after`` by
    word place, comma-joined) to every row. Null and empty texts have no span; rows
    may repeat; other columns pass through."""
    templates = TEMPLATES if templates is None else templates
    made: list[Scanner] = []

    def batch(column: pa.Array) -> dict[str, list]:
        if not made:
            made.append(Scanner(templates, coverage))
        rows = [made[0].spans(t) for t in texts_of(column)]
        return {
            "licenses": [",".join(sorted({s[0] for s in r})) for r in rows],
            "n_spans": [len(r) for r in rows],
            "coverage": [max((s[1] for s in r), default=0.0) for r in rows],
            "spans": [",".join(f"{n}:{a}-{b}" for n, _, a, b in r) for r in rows],
        }

    return add_columns(df, text, batch, "licenses string, n_spans bigint, coverage double, spans string", keep)
