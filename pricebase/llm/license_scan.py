"""Licence notices by patience alignment.

Words unique to both a template and a stretch of text are anchors; their longest increasing subsequence fixes the
alignment, the gaps between anchors are aligned in the same way, and where a gap has no unique word its equal beginning
and end are taken. The coverage of a template is the share of its words that are aligned.

A find must also hold, word after word, the phrases that tell its licence from others (``MUST``: name, version, what sets it
apart), and none of those that make it another licence may be in it or follow it (``MUST_NOT``).

Words are runs of ASCII letters and digits and of other characters; only A-Z change case. A template is tried on a text
that holds enough of its words to reach the threshold, around every occurrence of its key words: its rarest words, so
many that without all of them the threshold is out of reach. So nothing is missed by looking only there.

Defined results: a null or empty text has no notice; of overlapping finds the one that covers most stays (of equals the longer
template, then the earlier); long texts are read whole; repeated rows are scanned separately; a null id is kept.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebase.llm.common import prepared

COVERAGE = 0.8

# Wordings of public licences and of the notices that name them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    *[
        (
            f"{short}-or-later",
            "This program is free software: you can redistribute it and/or modify it under the terms of the "
            f"{name} as published by the Free Software Foundation, either version {short[-3]} of the License, or (at your option) any later version.",
        )
        for short, name in (
            ("GPL-2.0", "GNU General Public License"),
            ("LGPL-3.0", "GNU Lesser General Public License"),
            ("AGPL-3.0", "GNU Affero General Public License"),
        )
    ],
]

_CC = "creative commons attribution"
#: Per licence the phrases of which one must be held whole, for each row one. Licences without an entry ask for none.
MUST: dict[str, list[tuple[str, ...]]] = {
    "MIT": [("mit license", "permission is hereby granted"), ("mit license", "this permission notice shall be included")],
    "ISC": [("and or distribute this software for any purpose",)],
    "BSD-2-Clause": [("redistribution and use in source and binary forms",)],
    "BSD-3-Clause": [("redistribution and use in source and binary forms",), ("neither the name",), ("endorse or promote",)],
    "Apache-2.0": [("apache license version 2 0",)],
    "MPL-2.0": [("mozilla public license v 2 0",)],
    "CC-BY-4.0": [("cc by 4 0", f"{_CC} 4 0")],
    "CC-BY-SA-4.0": [("cc by sa 4 0", f"{_CC} sharealike 4 0")],
    "CC-BY-NC-4.0": [("cc by nc 4 0", f"{_CC} noncommercial 4 0")],
    "CC-BY-NC-SA-4.0": [("cc by nc sa 4 0", f"{_CC} noncommercial sharealike 4 0")],
} | {
    f"{short}-{version}.0{later}": [(f"gnu {name}general public license",), phrases]
    for short, name in (("GPL", ""), ("LGPL", "lesser "), ("AGPL", "affero "))
    for version in (2, 3)
    for later, phrases in (("", (f"public license version {version}",)), ("-or-later", (f"version {version} of the license or at your option any later version",)))
}
#: Per licence: phrases that contradict it, and how many words after the find they are looked for, too.
MUST_NOT: dict[str, tuple[tuple[str, ...], int]] = {
    "BSD-2-Clause": (("endorse or promote", "neither the name"), 60),
    **{f"{k}-{v}.0": (("or later", "or any later", "or at your option"), 5) for k in ("GPL", "LGPL", "AGPL") for v in (2, 3)},
}

_SPACED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(_SPACED).split()


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned positions of equal words, increasing in both."""
    found, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b]
        if not anchors:
            continue
        chain = increasing(anchors)
        found += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]) if x + 1 < u and y + 1 < v]
    return sorted(found)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence that also increases in the second place (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, (_, y) in enumerate(pairs):
        pile = bisect.bisect_left(tops, y)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[pile], piles[pile] = y, i
    chain, i = [], piles[-1] if piles else -1
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    return chain[::-1]


def _within(phrase: list[bytes], words: list[bytes]) -> bool:
    n = len(phrase)
    return any(w == phrase[0] and words[i : i + n] == phrase for i, w in enumerate(words))


@dataclass(frozen=True)
class Find:
    license: str
    coverage: float
    matched: int
    first: int
    last: int


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words_of(text)) for name, text in templates]
        self.must = {name: [[words_of(p) for p in phrases] for phrases in rows] for name, rows in MUST.items()}
        self.must_not = {name: ([words_of(p) for p in phrases], after) for name, (phrases, after) in MUST_NOT.items()}
        spread = Counter(w for _, words in self.templates for w in set(words))
        self.counts = [Counter(words) for _, words in self.templates]
        self.vocabulary = frozenset(spread)
        #: per template: key word -> its places in it
        self.keys: list[dict[bytes, list[int]]] = []
        for (_, words), counts in zip(self.templates, self.counts):
            keys: dict[bytes, list[int]] = {}
            weight = 0
            for word in sorted(counts, key=lambda w: (spread[w], -len(w), w)):
                if weight > len(words) * (1 - coverage):
                    break
                weight += counts[word]
                keys[word] = [i for i, w in enumerate(words) if w == word]
            self.keys.append(keys)

    def _tries(self, words: list[bytes], number: int) -> Iterator[tuple[int, int]]:
        """Stretches to align with a template: first as long as itself, then with room for insertions."""
        size = len(self.templates[number][1])
        tried = set()
        for at, word in enumerate(words):
            for place in self.keys[number].get(word, ()):
                for slack in (0, size // 4 + 2):
                    stretch = (max(0, at - place - slack), min(len(words), at - place + size + slack))
                    if stretch not in tried:
                        tried.add(stretch)
                        yield stretch

    def _tells(self, name: str, template: list[bytes], words: list[bytes], first: int, last: int) -> bool:
        """Whether the words of a find tell this licence; only what its template itself holds can be asked for."""
        held = words[first : last + 1]
        for phrases in self.must.get(name, ()):
            if (own := [p for p in phrases if _within(p, template)]) and not any(_within(p, held) for p in own):
                return False
        phrases, after = self.must_not.get(name, ((), 0))
        return not any(_within(p, words[first : last + 1 + after]) for p in phrases)

    def scan(self, text: str) -> list[Find]:
        words = words_of(text)
        present = self.vocabulary.intersection(words)
        if not present:
            return []
        found = []
        for number, (name, template) in enumerate(self.templates):
            needed = math.ceil(self.coverage * len(template))
            if sum(n for w, n in self.counts[number].items() if w in present) < needed:
                continue
            for start, end in self._tries(words, number):
                pairs = align(template, words[start:end])
                if len(pairs) >= needed and self._tells(name, template, words, start + pairs[0][1], start + pairs[-1][1]):
                    found.append(Find(name, len(pairs) / len(template), len(pairs), start + pairs[0][1], start + pairs[-1][1]))
        kept: list[Find] = []
        firsts: list[int] = []
        for find in sorted(found, key=lambda f: (-f.coverage, -f.matched, f.first, f.license)):
            # what stays is disjoint, so its firsts and lasts are in the same order
            i = bisect.bisect_left(firsts, find.first)
            if (i == 0 or kept[i - 1].last < find.first) and (i == len(kept) or kept[i].first > find.last):
                kept.insert(i, find)
                firsts.insert(i, find.first)
        return kept


_FOUND = "license: string, coverage: double, matched_words: int, first_word: long, last_word: long"


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id and ``notices``, an array of license, coverage, matched_words, first_word, last_word in text order."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            notices = [
                [{"license": f.license, "coverage": f.coverage, "matched_words": f.matched, "first_word": f.first, "last_word": f.last} for f in scanner.scan(t)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(notices, kind)], ["doc_id", "notices"])

    return rows.mapInArrow(run, f"doc_id long, notices array<struct<{_FOUND}>>")
