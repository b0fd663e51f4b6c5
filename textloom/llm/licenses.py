"""License scans by conditional compression.

Candidate blocks are runs of lines with licensing words, grown on both sides by as many words as a notice can have, so
that wrapped notices are whole. Within a block every template whose decisive words (names, versions) are all there is
compared word by word: short notices around each place of their rarest decisive word, long texts along the runs of five
words that they share with the block. A place is confirmed if few of the template's words are missing there, few are put in,
and all decisive words are there. Each confirmed place is compressed, words alone, with zstandard by itself and with the template's words as a raw
dictionary; the places are ranked by the bytes that this saves, so that a license's whole text goes before its first
sentence, and take their words in that order (of equal savings that with the fewest differences first, then the template
that comes first). All places are found in one sweep and ranked once: a block with many thousand notices takes time in proportion.

SPDX lines are expressions: all license ids of one are found, without the exceptions that WITH adds; `+` is "or later".

Templates are the texts of short licenses and the usual notices. whole_texts(folder) makes more of a folder of plain
license texts (GPL, LGPL, MPL, Apache, CC0 ...), whose names are in FILES; the query uses FOLDER where it exists.

Texts without a trigger word never leave the JVM: one scan and projection, and one Arrow pass over what is left.

Defined results: null and empty texts have no licenses. Two notices on one line are both found. Repeated rows and null ids are judged one by one. Very long texts
and lines are compared whole. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    decisive: tuple[str, ...]


# licenses' own texts and common notices, and the words that tell them apart.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_MIT_REST = ', including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_BOOST = "Distributed under the Boost Software License, Version 1.0."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
#: Ids of SPDX expressions that are spelt as here; others are given as they are written.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "BSL-1.0", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
)
#: Files of a folder of whole license texts, and what they hold.
FOLDER = "/usr/share/common-licenses"
FILES = {
    "Apache-2.0": ("Apache-2.0", ("apache", "license", "2", "0")), "GPL-2": ("GPL-2.0", ("gnu", "general", "public", "2")), "GPL-3": ("GPL-3.0", ("gnu", "general", "public", "3")),
    "LGPL-2.1": ("LGPL-2.1", ("gnu", "lesser", "public", "2", "1")), "LGPL-3": ("LGPL-3.0", ("gnu", "lesser", "public", "3")), "MPL-1.1": ("MPL-1.1", ("mozilla", "public", "1", "1")),
    "MPL-2.0": ("MPL-2.0", ("mozilla", "public", "2", "0")), "CC0-1.0": ("CC0-1.0", ("cc0", "1", "0", "waiver")),
}
TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("mit", "license")),
    Template("MIT", "The MIT License (MIT)", ("mit", "license")),
    Template("MIT", "MIT License", ("mit", "license")),
    Template("MIT", _MIT_GRANT, ("permission", "hereby", "granted", "free", "charge", "deal")),
    Template("MIT", _MIT_GRANT + _MIT_REST, ("permission", "hereby", "granted", "free", "charge", "deal", "noninfringement")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "license", "2", "0")),
    Template("Apache-2.0", _APACHE, ("apache", "2", "0", "compliance")),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", ("apache", "license", "2", "0", "january", "2004")),
    Template("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("gnu", "general", "public", "3", "june", "2007")),
    Template("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ("gnu", "general", "public", "2", "june", "1991")),
    Template("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ("gnu", "general", "public", "version", "2", "published")),
    Template("GPL-2.0-only", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ("gnu", "general", "public", "version", "2", "published")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "3")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "2")),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "public", "3")),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "public", "3")),
    Template("GPL-3.0-or-later", _GNU.format("General Public License", "3"), ("gnu", "general", "public", "version", "3", "later")),
    Template("GPL-2.0-or-later", _GNU.format("General Public License", "2"), ("gnu", "general", "public", "version", "2", "later")),
    Template("LGPL-3.0-or-later", _GNU.format("Lesser General Public License", "3"), ("gnu", "lesser", "public", "version", "3", "later")),
    Template("LGPL-2.1-or-later", _GNU.format("Lesser General Public License", "2.1"), ("gnu", "lesser", "public", "version", "2", "1", "later")),
    Template("AGPL-3.0-or-later", _GNU.format("Affero General Public License", "3"), ("gnu", "affero", "public", "version", "3", "later")),
    Template("BSD", _BSD_HEAD, ("redistribution", "source", "binary", "permitted", "conditions")),
    Template("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_END, ("redistribution", "source", "binary", "permitted", "conditions", "reproduce", "disclaimed")),
    Template("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_THREE + _BSD_END, ("redistribution", "source", "binary", "permitted", "conditions", "reproduce", "endorse", "disclaimed")),
    Template("BSD-3-Clause", "Released under the BSD 3-Clause License.", ("bsd", "3", "clause")),
    Template("ISC", _ISC, ("permission", "use", "fee", "hereby", "granted", "appear")),
    Template("Zlib", _ZLIB, ("provided", "as", "is", "anyone", "alter", "restrictions")),
    Template("Unlicense", _UNLICENSE, ("unencumbered", "public", "domain")),
    Template("BSL-1.0", _BOOST, ("boost", "license", "1", "0")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "public", "2", "0")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4", "0")),
    Template("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", ("creative", "commons", "attribution", "4", "0")),
    Template("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", ("creative", "commons", "attribution", "sharealike", "4", "0")),
    Template("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", ("creative", "commons", "attribution", "noncommercial", "4", "0")),
    Template("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", ("creative", "commons", "attribution", "noderivatives", "4", "0")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by", "sa", "4", "0")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc", "4", "0")),
    Template("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ("cc", "by", "nd", "4", "0")),
    Template("CC0-1.0", "Dedicated to the public domain under CC0 1.0.", ("cc0", "1", "0")),
    Template("proprietary", "All rights reserved.", ("all", "rights", "reserved")),
)

TRIGGERS = r"(?i)licen[sc]e|copyright|rights\s+reserved|permission\s+(?:is|to\s+use)|implied\s+warranty|redistribution|public\s+domain|spdx|creative\s+commons"
#: Words that let a block go on to a neighbouring line.
_GOES_ON = re.compile(TRIGGERS[4:] + r"|software|warrant|liab|permitted|conditions|notice|merchantab", re.I)
_BEGINS = re.compile(TRIGGERS[4:], re.I)
_WORDS = re.compile(r"[0-9a-z]+")
_ANY_WORD = re.compile(r"[0-9A-Za-z]+")
#: Share of a template's words that may be missing.
MISSING = 0.15
#: Templates of so many words are aligned by runs of RUN words; what a block grows by is the length of the longest below WHOLE.
LONG, RUN, WHOLE = 60, 5, 500

_SPDX_ID = r"[0-9A-Za-z][0-9A-Za-z.\-]*\+?"
_SPDX_LINE = re.compile(rf"SPDX-License-Identifier[ \t]*:[ \t]*([( \t]*{_SPDX_ID}[) \t]*(?:(?:AND|OR|WITH)[ \t(]+{_SPDX_ID}[) \t]*)*)", re.I)
_SPDX_TERM = re.compile(rf"(WITH[ \t]+)?({_SPDX_ID})", re.I)
_SPELT = {x.lower(): x for x in SPDX}


def spdx_ids(expression: str) -> list[str]:
    """The license ids of an SPDX expression, in order."""
    found = []
    for with_, name in _SPDX_TERM.findall(expression):
        if with_ or name.upper() in ("AND", "OR"):
            continue
        old = name.rstrip("+.").lower()
        family = old if not old.endswith(("-only", "-or-later")) and re.match(r"(a|l)?gpl-[0-9.]+$", old) else None
        name = f"{family}-{'or-later' if '+' in name else 'only'}" if family else name.rstrip(".")
        found.append(_SPELT.get(name.lower(), name.upper().replace("-OR-LATER", "-or-later").replace("-ONLY", "-only") if family else name))
    return found


def whole_texts(folder: str = FOLDER) -> tuple[Template, ...]:
    """Templates of the license texts in a folder; none where it isn't there."""
    return tuple(Template(name, (Path(folder) / file).read_text("utf-8", "replace"), decisive) for file, (name, decisive) in FILES.items() if (Path(folder) / file).is_file())


def _slack(words: int) -> int:
    """Words that may be put into a template of so many."""
    return int(max(2, MISSING * words))


def _longest(templates: tuple[Template, ...]) -> int:
    lengths = (len(_WORDS.findall(t.text.lower())) for t in templates)
    return max((n + _slack(n) for n in lengths if n < WHOLE), default=0)


def blocks(text: str, grow: int | None = None) -> Iterator[tuple[int, str]]:
    """(first line's number, text) of runs of lines with licensing words, with `grow` words around them; runs that meet are one."""
    grow = _longest(TEMPLATES) if grow is None else grow
    runs: list[list] = []
    for m in _GOES_ON.finditer(text):
        if runs and m.end() <= runs[-1][1]:  # on a line that is known already
            runs[-1][2] = runs[-1][2] or bool(_BEGINS.match(m[0]))
            continue
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        b, trigger = len(text) if b < 0 else b, bool(_BEGINS.match(m[0]))
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1:] = max(b, runs[-1][1]), runs[-1][2] or trigger
        else:
            runs.append([a, b, trigger])
    runs = [r[:2] for r in runs if r[2]]
    words = [m.span() for m in _ANY_WORD.finditer(text)] if runs else []
    begins, ends = [a for a, _ in words], [b for _, b in words]
    grown: list[list[int]] = []
    for a, b in runs:
        i, j = bisect_left(begins, a) - grow, bisect_right(ends, b) + grow - 1
        a, b = min(a, begins[max(i, 0)]), max(b, ends[min(j, len(ends) - 1)])
        if grown and a <= grown[-1][1]:
            grown[-1][1] = max(b, grown[-1][1])
        else:
            grown.append([a, b])
    for a, b in grown:
        yield text.count("\n", 0, a), text[a:b]


class _Taken:
    """Stretches that don't overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, a: int, b: int) -> bool:
        """Takes from a to b, if all of it is free."""
        k = bisect_right(self.starts, a)
        if (k and self.ends[k - 1] > a) or (k < len(self.starts) and self.starts[k] < b):
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


class Scanner:
    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        import zstandard as z

        self.templates = templates
        self.plain = z.ZstdCompressor(level=3, write_content_size=False)
        self.words = [_WORDS.findall(t.text.lower()) for t in templates]
        self.given = [z.ZstdCompressor(level=3, write_content_size=False, dict_data=z.ZstdCompressionDict(" ".join(w).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for w in self.words]
        self.runs = [self._unique_runs(w) if len(w) >= LONG else None for w in self.words]

    @staticmethod
    def _unique_runs(words: list[str]) -> dict[tuple[str, ...], int]:
        places: dict[tuple[str, ...], list[int]] = {}
        for i in range(len(words) - RUN + 1):
            places.setdefault(tuple(words[i : i + RUN]), []).append(i)
        return {run: at[0] for run, at in places.items() if len(at) == 1}

    def saved(self, words: list[str], i: int) -> int:
        """Bytes of these words that template i saves as a dictionary."""
        data = " ".join(words).encode()
        return len(self.plain.compress(data)) - len(self.given[i].compress(data))

    def _short(self, have: list[str], at: dict[str, list[int]], i: int) -> Iterator[tuple[int, int, int, int]]:
        want, decisive = self.words[i], self.templates[i].decisive
        anchor = min(decisive, key=lambda w: len(at[w]))
        before, slack = want.index(anchor), _slack(len(want))
        for p in at[anchor]:
            low, high = max(0, p - before - slack), p - before + len(want) + slack
            if any((k := bisect_left(at[w], low)) == len(at[w]) or at[w][k] >= high for w in decisive):
                continue
            found = [m for m in SequenceMatcher(None, want, have[low:high], autojunk=False).get_matching_blocks() if m.size]
            # words of the surroundings may match at the ends: of all runs of matches the one with the fewest differences counts
            fits = []
            for x in range(len(found)):
                for y in range(x, len(found)):
                    size = sum(m.size for m in found[x : y + 1])
                    missing, first, end = len(want) - size, found[x].b, found[y].b + found[y].size
                    inserted = end - first - size
                    if missing <= MISSING * len(want) and inserted <= slack and set(decisive) <= {w for m in found[x : y + 1] for w in want[m.a : m.a + m.size]}:
                        fits.append((missing + inserted, missing, inserted, low + first, low + end))
            if fits:
                yield min(fits)[1:]

    def _long(self, have: list[str], i: int) -> Iterator[tuple[int, int, int, int]]:
        want, runs, decisive = self.words[i], self.runs[i], self.templates[i].decisive
        slack = _slack(len(want))
        chains: list[list[tuple[int, int]]] = []
        for t in range(len(have) - RUN + 1):
            m = runs.get(tuple(have[t : t + RUN]))
            if m is None:
                continue
            if chains and m > chains[-1][-1][1] and abs((t - m) - (chains[-1][0][0] - chains[-1][0][1])) <= slack:
                chains[-1].append((t, m))
            else:
                chains.append([(t, m)])
        for chain in chains:
            if len(chain) * RUN < (1 - MISSING) * len(want):
                continue
            template, text = {m + j for _, m in chain for j in range(RUN)}, {t + j for t, _ in chain for j in range(RUN)}
            first, end = chain[0][0], chain[-1][0] + RUN
            missing, inserted = len(want) - len(template), end - first - len(text)
            if missing <= MISSING * len(want) and inserted <= slack and set(decisive) <= {want[m] for m in template}:
                yield missing, inserted, first, end

    def places(self, block: str) -> list[tuple[int, int, int, int, int, int]]:
        """(bytes saved, template, missing, inserted, first byte, last + 1) of all confirmed places of a block in lower case."""
        spans = [m.span() for m in _WORDS.finditer(block)]
        have = [block[a:b] for a, b in spans]
        at: dict[str, list[int]] = {}
        for p, w in enumerate(have):
            at.setdefault(w, []).append(p)
        out = []
        for i, t in enumerate(self.templates):
            if all(w in at for w in t.decisive):
                taken = _Taken()  # where a template fits in several ways, that with the fewest differences is its place
                found = self._long(have, i) if self.runs[i] else self._short(have, at, i)
                for missing, inserted, a, b in sorted(found, key=lambda x: (x[0] + x[1], x)):
                    if taken.take(a, b):
                        out.append((self.saved(have[a:b], i), i, missing, inserted, spans[a][0], spans[b - 1][1]))
        return out

    def every(self, first: int, block: str) -> Iterator[tuple[int, str, int, int, int]]:
        """(line, name, missing, inserted, bytes saved) of all licenses of a block, in order."""
        low = block.lower()
        low = low if len(low) == len(block) else "".join(c if len(c.lower()) != 1 else c.lower() for c in block)
        taken, found = _Taken(), []
        for m in _SPDX_LINE.finditer(block):
            taken.take(*m.span())
            found += [(m.start(), n, name, 0, 0, 0) for n, name in enumerate(spdx_ids(m[1]))]
        for saved, i, missing, inserted, a, b in sorted(self.places(low), key=lambda x: (-x[0], x[2] + x[3], x[1], x[4])):
            if taken.take(a, b):
                found.append((a, 0, self.templates[i].name, missing, inserted, saved))
        line, seen = first, 0
        for a, _, name, missing, inserted, saved in sorted(found):
            line, seen = line + block.count("\n", seen, a), a
            yield line, name, missing, inserted, saved


_FOUND = pa.list_(pa.struct([("line", pa.int32()), ("license", pa.string()), ("missing", pa.int32()), ("inserted", pa.int32()), ("saved", pa.int32())]))
_SCHEMA = "doc_id long, n_blocks int, found array<struct<line: int, license: string, missing: int, inserted: int, saved: int>>"


def _scan(templates: tuple[Template, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, grow = Scanner(templates), _longest(templates)
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                t = text.as_py()
                own = list(blocks(t, grow)) if t else []
                counts.append(len(own))
                found.append([x for line, b in own for x in scanner.every(line, b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(found, _FOUND)], ["doc_id", "n_blocks", "found"])

    return run


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_blocks, licenses (distinct, sorted), found (line, license, missing and inserted words, bytes saved)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(TRIGGERS), F.col("text")).alias("text"))
    got = own.mapInArrow(_scan(templates), _SCHEMA)
    return got.select("doc_id", "n_blocks", F.array_sort(F.array_distinct("found.license")).alias("licenses"), "found")
