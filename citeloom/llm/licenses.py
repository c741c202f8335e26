"""License scans by patience alignment.

Words that stand once in a template lead to its copies in a text: they are chained, ascending in
both, and a chain that holds enough of them is a copy, its neighbours' words left to them. Text
and template are then aligned there: words unique to both sides are anchors, the longest
increasing subsequence of them is kept, and the gaps between anchors are aligned in the same
way. The share of the template's words that are aligned is its coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import textkit as tk
from citeloom.llm.runtime import spread

COVERAGE = 0.8
#: Words put into a copy at one place, in template lengths, up to which it stays one copy.
INSERTED = 1

# The wordings of the licenses.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "MIT (line)": "Released under the MIT License.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
}


def _unique(words: list, low: int, high: int) -> dict:
    seen: dict = {}
    for i in range(low, high):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def patience(left: list, right: list) -> list[tuple[int, int]]:
    """Aligned places (i, j), ascending in both, of two word lists."""
    out, work = [], [(0, len(left), 0, len(right))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            out.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a == b or c == d:
            continue
        other = _unique(right, c, d)
        shared = [(i, other[w]) for w, i in _unique(left, a, b).items() if w in other]
        piles: list[int] = []
        tops: list[int] = []
        before: list[int] = []
        for n, (_, j) in enumerate(shared):  # ascending in i
            at = bisect_left(piles, j)
            before.append(tops[at - 1] if at else -1)
            piles[at : at + 1], tops[at : at + 1] = [j], [n]
        chain, n = [], tops[-1] if tops else -1
        while n >= 0:
            chain.append(shared[n])
            n = before[n]
        if not chain:
            continue
        out += chain
        edges = [(a - 1, c - 1), *reversed(chain), (b, d)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


class Template:
    """A template's words, and the rarest of them (those that stand once, if there are such) with their places."""

    def __init__(self, words: list[int]) -> None:
        self.words, self.need = words, int(np.ceil(COVERAGE * len(words)))
        places: dict[int, list[int]] = {}
        for j, w in enumerate(words):
            places.setdefault(w, []).append(j)
        least = min(map(len, places.values()), default=0)
        self.anchors = {w: found for w, found in places.items() if len(found) == least}
        every = sorted(j for found in self.anchors.values() for j in found)
        self.rank = {j: i for i, j in enumerate(every)}
        self.places = np.array(every, np.int64)
        self.fewest = max(1, len(every) - (len(words) - self.need))  # of anchors: each one missing is a word missing

    def chains(self, at: list[int], words: list[int]) -> list[tuple[int, int, int, int]]:
        """(first place, its word of the template, last place, its word) of likely copies, in order and apart, from the anchors' places in a text.

        A chain gains one for each anchor and loses, for each word more than the template has
        between two of them, what a word missing may cost a copy. So a copy with a part put in
        stays whole, while linking two copies costs more than any copy may lack.
        """
        n = len(self.places)
        last = np.full(n, -(1 << 40), np.int64)  # where each anchor was met last, the score of its chain, its first hit, and how many
        score, begun, number = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        found: dict[int, tuple[float, int, int, int, int]] = {}  # by first hit: the best end
        price, reach = 1 - COVERAGE, len(self.words) * (1 + INSERTED)
        for k, (p, w) in enumerate(zip(at, words)):
            made = []
            for j in self.anchors[w]:
                r = self.rank[j]
                gain, start, count = 1.0, k, 1
                if r:
                    gap = p - last[:r]
                    linked = np.where(gap <= reach, score[:r] - price * np.maximum(0, gap - (j - self.places[:r])), -1.0)
                    best = int(linked.argmax())
                    if linked[best] > 0:
                        gain, start, count = 1.0 + linked[best], int(begun[best]), int(number[best]) + 1
                made.append((r, gain, start, count, j))
            for r, gain, start, count, j in made:  # one place is one word of a chain
                last[r], score[r], begun[r], number[r] = p, gain, start, count
                if count >= self.fewest and gain > found.get(start, (0.0,))[0]:
                    found[start] = (gain, p, j, start, count)
        out: list[tuple[int, int, int, int]] = []
        first = lambda start: min(self.anchors[words[start]])
        taken: list[tuple[int, int]] = []
        for _, p, j, start, _ in sorted(found.values(), key=lambda x: (-x[0], x[3])):
            low = at[start]
            i = bisect_left(taken, (low, -1))
            if (i == 0 or taken[i - 1][1] < low) and (i == len(taken) or p < taken[i][0]):
                taken.insert(i, (low, p))
                out.append((low, first(start), p, j))
        return sorted(out)


class Scanner:
    """Templates as word hashes, and which words lead to which of them."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        raw, at = tk.utf8(pa.array(list(templates.values()), pa.string()))
        w = tk.words(raw, at, tk.ALNUM)
        self.templates = [Template(w.hashes[w.first[i] : w.first[i + 1]].tolist()) for i in range(len(templates))]
        self.words = [x.words for x in self.templates]

    def matches(self, w: tk.Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, template, coverage, first word, end word); matches of a template don't overlap, those of most coverage go first."""
        if not len(w.hashes):
            return
        document = w.documents()
        for t, template in enumerate(self.templates):
            if not template.words:
                continue
            hits = np.flatnonzero(np.isin(w.hashes, np.array(list(template.anchors), w.hashes.dtype)))
            reach = (2 + INSERTED) * len(template.words)
            near = np.searchsorted(hits, hits + reach) - np.arange(len(hits))  # in reach from each on
            worth = np.zeros(len(hits) + 1, np.int64)
            begin = np.flatnonzero(near >= template.fewest)
            np.add.at(worth, begin, 1)
            np.add.at(worth, begin + near[begin], -1)
            hits = hits[np.cumsum(worth[:-1]) > 0]
            for some in np.split(hits, np.flatnonzero((np.diff(hits) > reach) | (np.diff(document[hits]) > 0)) + 1) if len(hits) else []:
                yield from self._copies(w, t, template, some.tolist(), int(document[some[0]]))

    def _copies(self, w: tk.Words, t: int, template: Template, at: list[int], d: int) -> Iterator[tuple[int, int, float, int, int]]:
        chains = template.chains(at, w.hashes[at].tolist())
        aligned = []
        for i, (low, j, high, k) in enumerate(chains):
            before = chains[i - 1][2] + 1 if i else int(w.first[d])
            after = chains[i + 1][0] if i + 1 < len(chains) else int(w.first[d + 1])
            begin, end = max(before, low - 2 * j - 4), min(after, high + 2 * (len(template.words) - k) + 4)
            pairs = patience(w.hashes[begin:end].tolist(), template.words)
            if len(pairs) < template.need:  # without the words around, what they repeat may be unique
                begin, pairs = low, patience(w.hashes[low : high + 1].tolist(), template.words)
            if len(pairs) >= template.need:
                aligned.append((-len(pairs), begin + pairs[0][0], begin + pairs[-1][0] + 1))
        used: list[tuple[int, int]] = []
        for less, begin, end in sorted(aligned):
            i = bisect_left(used, (begin, -1))
            if (i == 0 or used[i - 1][1] <= begin) and (i == len(used) or end <= used[i][0]):
                used.insert(i, (begin, end))
                yield d, t, -less / len(template.words), begin, end


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Rows (doc_id, n_licenses, license, coverage, licenses), one per row of `docs` (doc_id, text).

    licenses lists all matches as name:start:end in code points, by start and name, comma
    joined; license is the one of the highest coverage (ties: the longest template, then the
    earliest), null without one. Null and empty texts have none; rows that repeat a doc_id
    get their own answers.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates)
    schema = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("licenses", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, at in tk.chunks(batch.column(1)):
                w = tk.words(raw, at, tk.ALNUM)
                n, best, share, listed = [0] * (end - row), [None] * (end - row), [0.0] * (end - row), [[] for _ in range(end - row)]
                chars = None
                for d, t, coverage, first, stop in scanner.matches(w):
                    if chars is None:  # code points before each byte
                        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    start, close = (int(chars[x] - chars[at[d]]) for x in (w.starts[first], w.ends[stop - 1]))
                    listed[d].append((start, scanner.names[t], close, coverage, len(scanner.words[t])))
                for d, found in enumerate(listed):
                    found.sort()
                    n[d] = len(found)
                    if found:
                        top = min(found, key=lambda x: (-x[3], -x[4], x[0], x[1]))
                        best[d], share[d] = top[1], top[3]
                joined = [",".join(f"{x[1]}:{x[0]}:{x[2]}" for x in found) for found in listed]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(n, pa.int64()), pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array(joined, pa.string())], schema=schema)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(given).mapInArrow(run, "doc_id long, n_licenses long, license string, coverage double, licenses string")
