"""License scans: texts and their parts against licence templates by Dice coefficient over word bigrams.

Normal form: lower case, runs of letters and digits as words. Units are each line, each
paragraph (lines up to a blank one), the whole text, and windows: where a text holds enough of a
template's bigrams, each stretch of no more words than the template that has enough of them,
from its first such bigram to its last. So a notice or a licence is found amid other words. A unit matches a template if
2 |A and B| / (|A| + |B|) of their sets of word bigrams is `least` or more. Two bounds prune:
the coefficient needs |A| and |B| within a factor of least / (2 - least) of each other, and
|A and B| of at least least / 2 of their sum; so templates are first looked up by size, and a
unit is compared only with templates that share that many bigrams, counted over an index of
all templates' bigrams. Neither loses a match.

Scale: templates are a fixed list shipped with the code, notices here and whole licences in
license_texts. Texts are scored where they are read.

Edge cases: a null or empty text has no match; a unit or template of one word has that word as
its only "bigram"; repeated rows give repeated matches. For each text and template the best
unit counts; of equal ones the longest, then the first. A unit counts for the template that
it resembles most, and for all that it resembles as much. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import pkgutil
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm.common import id_and_text, read

LEAST = 0.8
WORD = re.compile(r"[^\W_]+")

WHOLE = ("Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Zlib")

# fixed values: notices that name public licences or open them, and the whole licences
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    # both licences begin so
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, pkgutil.get_data(__name__, f"license_texts/{name}.txt").decode()) for name in WHOLE),
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} if words else set()


@functools.cache
def shipped() -> Templates:
    return Templates(TEMPLATES, LEAST)


def units(text: str, known: Templates | None = None) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of lines, paragraphs of more than one line, a text of more than one paragraph, and windows of the known templates (the shipped ones)."""
    at, begin, n_lines, n_parts = 0, None, 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            yield "line", at, end
            begin = at if begin is None else begin
            n_lines, last = n_lines + 1, end
        elif begin is not None:
            if n_lines > 1:
                yield "paragraph", begin, last
            begin, n_lines, n_parts = None, 0, n_parts + 1
        at = end + 1
    if begin is not None:
        if n_lines > 1:
            yield "paragraph", begin, last
        n_parts += 1
    if n_parts > 1:
        yield "text", 0, len(text)
    for start, end in sorted(set((known or shipped()).windows(text))):
        yield "window", start, end


class Templates:
    """The templates' bigram sets, their sizes, and an index from bigrams to templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float) -> None:
        self.least = least
        self.names = [name for name, _ in templates]
        self.sets = [bigrams(words_of(t)) for _, t in templates]
        self.sizes = list(map(len, self.sets))
        self.lengths = [len(words_of(t)) for _, t in templates]
        self.index = defaultdict(list)
        for i, s in enumerate(self.sets):
            for b in s:
                self.index[b].append(i)
        self.ratio = least / (2 - least)
        self.by_size = sorted((n, i) for i, n in enumerate(self.sizes))
        self.smallest, self.largest = self.by_size[0][0] * self.ratio, self.by_size[-1][0] / self.ratio

    def of_size(self, n: int) -> set[int]:
        """The templates that a unit of n bigrams can match by size."""
        low, high = bisect_left(self.by_size, (n * self.ratio * (1 - 1e-12), -1)), bisect_right(self.by_size, (n / self.ratio * (1 + 1e-12), len(self.sizes)))
        return {i for _, i in self.by_size[low:high]}

    def windows(self, text: str) -> Iterator[tuple[int, int]]:
        """Candidates that match their template, but for those with most of their length in one that shares more bigrams with its own: a cut-out of one licence's notice can resemble another's."""
        matching = []
        for i, start, end in self.candidates(text):
            unit = bigrams(words_of(text[start:end]))
            both = len(unit & self.sets[i])
            if 2 * both >= self.least * (len(unit) + self.sizes[i]):
                matching.append((both, start, end))
        kept: list[tuple[int, int, int]] = []
        for both, start, end in sorted(matching, reverse=True):
            if not any(more > both and 2 * (min(end, z) - max(start, a)) > end - start for more, a, z in kept):
                kept.append((both, start, end))
                yield start, end

    def candidates(self, text: str) -> Iterator[tuple[int, int, int]]:
        """For each template, stretches that may match: those that begin and end with one of its bigrams, hold no more words than it has, and share enough bigrams, as near to each other as they come."""
        found = list(WORD.finditer(text))
        said = [m[0].lower() for m in found]
        hits: dict[int, list[int]] = defaultdict(list)
        get = self.index.get
        for at, b in enumerate(zip(said, said[1:], strict=False)):
            for i in get(b, ()):
                hits[i].append(at)
        for i, at in hits.items():
            # at least bigrams in common; a match has no fewer than least / 2 of the two sizes' sum
            enough = self.sizes[i] * self.least / (2 - self.least)
            if len(at) < enough:
                continue
            reach = [bisect_right(at, a + self.lengths[i] - 2) for a in at]  # a window's bigrams are at[k : reach[k]]
            k = 0
            while k < len(at):
                if reach[k] - k < enough:
                    k += 1
                    continue
                last = reach[k]  # of the windows that begin within this one, the fullest
                best = max(range(k, last), key=lambda j: reach[j] - j)
                yield i, found[at[best]].start(), found[at[reach[best] - 1] + 1].end()
                k = max(reach[best], k + 1)

    def match(self, text: str) -> list[tuple[str, float, str, int, int]]:
        """(license, score, unit, start, end) of the best unit for each licence."""
        best: dict[str, tuple] = {}
        get = self.index.get
        for kind, start, end in units(text, self):
            if end - start < self.smallest:
                continue
            words = words_of(text[start:end])
            unit = bigrams(words)
            n = len(unit)
            able = self.of_size(n)
            if not able:
                continue
            shared: dict[int, int] = {}
            for b in unit:
                for i in get(b, ()):
                    if i in able:
                        shared[i] = shared.get(i, 0) + 1
            scored = [(2 * both / (n + self.sizes[i]), self.names[i]) for i, both in shared.items()]
            top = max(scored, default=(0.0, ""))[0]
            for score, name in scored:
                if score == top >= self.least:  # a notice that resembles several is the one it resembles most
                    rank = (score, end - start, -start)
                    if name not in best or rank > best[name][0]:
                        best[name] = (rank, (name, score, kind, start, end))
        return sorted(x for _, x in best.values())


FOUND = "array<struct<license: string, score: double, unit: string, start: long, end: long>>"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, score, unit, start, end (code points) of every licence found in a text."""

    @F.pandas_udf(FOUND)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Templates(templates, least)
        names = ("license", "score", "unit", "start", "end")
        for t in texts:
            yield pd.Series([[dict(zip(names, m, strict=True)) for m in known.match(x)] for x in t])

    return id_and_text(docs).select("doc_id", F.explode(of("text")).alias("m")).select("doc_id", "m.*")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
