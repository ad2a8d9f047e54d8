"""Licence scans by sentence rules: known sentences have identifiers, and rules match sequences of these.

A text is cut into sentences at line ends and after `.`, `!`, `?`, `;` or `:` before white space. Each is
lower-cased and every run of other than letters and digits becomes one space; the result is looked up in
a table of licence sentences. Notices in files are wrapped, so runs of consecutive lines are looked up as
well, joined up to the longest known sentence; a run ends at a sentence's end and at a blank line, and
comment marks at the start of a line are skipped. A long known sentence is also found at the end of one
that a heading without a mark has run into. A licence is then recognised where the identifiers of a rule follow one
another in the text with at most `GAP` other sentences between two of them. Rules are tried in order, the
longest and most particular first, and a sentence serves one rule only.

Defined results: null and empty texts and texts without a known sentence give no row; a licence that a
text states several times gives a row each time; repeated rows and null ids are scanned like any other;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_batches

GAP = 2
#: Where a sentence ends; the abbreviation `v.` before a number ends none.
BREAK = re.compile(r"(?<=[.!?;:])(?<!\sv\.)\s+|\n+|\r+")
OTHER = re.compile(r"[\W_]+")
#: Comment marks that are words, at the start of a line; other marks are no letters and vanish in the normal form.
MARK = re.compile(r"[ \t]*(?:rem|dnl|c)[ \t]+", re.I)
LINE_END = re.compile(r"\r\n|\n|\r")
#: The sentences of common licence texts, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-free": "This program is free software:",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "gpl3-version": "either version 3 of the License, or (at your option) any later version.",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
}
#: Names by which a sentence refers to a licence, by the licence's identifier.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3", "GPLv3", "GPL-3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License version 3", "AGPLv3", "AGPL-3.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
#: Sentences that refer to a licence by name.
FRAMES = ["Licensed under {}", "Licensed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "SPDX-License-Identifier: {}", "Licensed under {} (the \"License\")", "Licensed under the {} (the \"License\")"]
#: Ordered rules: identifiers of sentences that follow one another, and the licence that they state.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("mit-grant", "mit-notice", "mit-as-is", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("ref:Apache-2.0", "apache-use", "apache-copy", "apache-as-is"), "Apache-2.0"),
    (("ref:Apache-2.0", "apache-use"), "Apache-2.0"),
    (("gpl-free", "gpl-terms", "gpl3-version", "gpl-hope"), "GPL-3.0"),
    (("gpl-free", "gpl-terms", "gpl2-version", "gpl-hope"), "GPL-2.0"),
    (("gpl-free", "gpl-terms", "gpl3-version"), "GPL-3.0"),
    (("gpl-free", "gpl-terms", "gpl2-version"), "GPL-2.0"),
    (("gpl-free", "gpl3-terms", "gpl-hope"), "GPL-3.0"),
    (("gpl-free", "gpl2-terms", "gpl-hope"), "GPL-2.0"),
    (("gpl-free", "gpl3-terms"), "GPL-3.0"),
    (("gpl-free", "gpl2-terms"), "GPL-2.0"),
    (("isc-grant",), "ISC"),
    (("mpl-terms",), "MPL-2.0"),
    (("unlicense",), "Unlicense"),
    *(((f"ref:{licence}",), licence) for licence in NAMES),
    (("all-rights",), "LicenseRef-all-rights-reserved"),
]


def normal(sentence: str) -> str:
    return OTHER.sub(" ", sentence.lower()).strip()


def sentence_table() -> dict[str, str]:
    """Identifier of each known sentence in its normal form."""
    table = {}
    for identifier, text in SENTENCES.items():
        parts = [p for p in map(normal, BREAK.split(text)) if p]
        # A text is cut at the same marks, so a sentence with one inside is known by its parts joined, as lines are.
        table[" ".join(parts)] = identifier
    for licence, names in NAMES.items():
        for frame in FRAMES:
            for name in names:
                table[normal(frame.format(name))] = f"ref:{licence}"
                table.setdefault(normal(BREAK.split(frame.format(name))[-1]), f"ref:{licence}") if ":" in frame else None
    return table


TABLE = sentence_table()
ORDERED = sorted(TABLE)
#: The first words of long known sentences: one may begin after a heading that has no mark at its end.
OPENING = re.compile(" (?=(?:" + "|".join(sorted({re.escape(" ".join(s.split()[:4])) for s in TABLE if len(s.split()) >= 9})) + ") )")


def triggers(sentences: list[str]) -> list[str]:
    """Words of which each known sentence holds one, as few as a greedy choice gives: a text without any is clear."""
    left, found = [set(s.split()) for s in sentences], []
    while left:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                counts[w] = counts.get(w, 0) + len(w)  # long words are rarer
        best = max(sorted(counts), key=counts.__getitem__)
        found.append(best)
        left = [words for words in left if best not in words]
    return found


TRIGGERS = triggers(list(TABLE))


def sentences(text: str) -> list[tuple[int, int]]:
    """First and last place of each sentence."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, z) for a, z in out if a < z]


def starts_one(words: str) -> bool:
    """Whether a known sentence goes on after these words."""
    at = bisect_left(ORDERED, words + " ")
    return at < len(ORDERED) and ORDERED[at].startswith(words + " ")


def known_in(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]], list[int]]:
    """(first span, last span, identifier) of each known sentence, and the number of each span's sentence over all its lines."""
    words, numbers, number, closed = [], [], 0, True
    for k, (a, z) in enumerate(spans):
        gap = text[spans[k - 1][1] if k else 0 : a]
        ends = len(LINE_END.findall(gap))
        if (ends or not k) and (mark := MARK.match(text, a, z)):
            a = mark.end()
        words.append(normal(text[a:z]))
        if ends > 1 or closed or (not words[k] and ends and (k + 1 == len(spans) or LINE_END.search(text, z, spans[k + 1][0]))):
            number += 1
        numbers.append(number)
        # A mark such as `;` cut off at the start of a line ends no sentence.
        closed = text[z - 1] in ".!?;:" if words[k] else bool(LINE_END.search(text, z, spans[k + 1][0] if k + 1 < len(spans) else len(text)))

    def longest(k: int, joined: str) -> tuple[int, int, str] | None:
        """The longest known sentence of the words of span k and of the spans that go on with its sentence."""
        last, at = None, k
        while joined:
            if joined in TABLE:
                last = (k, at, TABLE[joined])
            if not starts_one(joined):
                break
            at += 1
            while at < len(spans) and numbers[at] == numbers[k] and not words[at]:
                at += 1
            if at == len(spans) or numbers[at] != numbers[k]:
                break
            joined += " " + words[at]
        return last

    found, k = [], 0
    while k < len(spans):
        last = longest(k, words[k])
        if not last and (n := normal(text[slice(*spans[k])])) in TABLE:
            last = (k, k, TABLE[n])
        if not last and (m := OPENING.search(words[k])):
            last = longest(k, words[k][m.end() :])
        if last:
            found.append(last)
        k = last[1] + 1 if last else k + 1
    return found, numbers


def recognised(text: str) -> list[tuple[str, str, int, int, int]]:
    """(licence, rule, sentence number of the first, start, length) of each licence that text states."""
    low = text.lower()
    if not any(t in low for t in TRIGGERS):
        return []
    spans = sentences(text)
    known, numbers = known_in(text, spans)
    used: set[int] = set()
    found = []
    for ids, licence in RULES:
        for first in range(len(known) - len(ids) + 1):
            run = known[first : first + len(ids)]
            if tuple(i for *_, i in run) != ids or any(k in used for k, *_ in run):
                continue
            if all(numbers[b[0]] - numbers[a[1]] <= GAP + 1 for a, b in zip(run, run[1:], strict=False)):
                used.update(k for k, *_ in run)
                start = spans[run[0][0]][0]
                found.append((licence, "+".join(ids), run[0][0], start, spans[run[-1][1]][1] - start))
    return sorted(found, key=lambda x: x[2])


def scanned(docs: DataFrame) -> DataFrame:
    """A row per licence stated: doc_id, licence, rule, sentence, start, length."""
    names = ["doc_id", "licence", "rule", "sentence", "start", "length"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *f) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for f in recognised(text or "")]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, licence string, rule string, sentence int, start long, length long")
