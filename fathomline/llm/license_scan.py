"""License scans by conditional compression.

A candidate block is a line or paragraph with a license cue, or of a long one a piece around each cue. It is
compressed once alone and once with each template as a raw dictionary; the more its size falls, the more of it
the template explains.
Templates are tried in order of the reduction, and one is confirmed by the exact differences in wording: words
added and words missing, of which none may be among the words that make the license what it is.

Blocks are local to a document, so nothing is shuffled. A task remembers the answers for a bounded
number of blocks, since notices repeat.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import Cache

LEVEL = 3
#: A confirmed block lacks at most this share of the template's words.
MISSING = 0.15
#: Lines and paragraphs of more characters are cut into pieces of so many. From 16 KB on zstandard takes other
#: parameters, and the size no longer falls.
STRETCH = 2400
#: Characters on both sides of a cue that lie in one piece with it: twice the longest template or more.
REACH = 900
CUES = ("licen", "copyright", "permission is hereby", "redistribution and use", "public domain", "creativecommons", "cc by", "cc-by", "cc0", "warrant", "permission is granted", "redistributions in binary", "to endorse or promote")


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    own: tuple[str, ...]  # words that must agree


# Wordings of license notices, as their publishers give them, and usual short forms.
TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MIT", "This project is licensed under the MIT License.", ("mit",)),
    Template("MIT", "SPDX-License-Identifier: MIT", ("mit",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", ("permission", "sublicense", "sell")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("apache", "2.0")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache", "2.0")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "2")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "3")),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "general", "3")),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu", "general", "2")),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "3")),
    Template("BSD-2-Clause OR BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ("redistribution", "source", "binary")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission", "fee")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by", "sa", "4.0")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc", "4.0")),
    Template("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ("cc", "by", "nd", "4.0")),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution", "4.0")),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived", "copyright")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered", "public", "domain")),
    Template("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistributions", "binary", "reproduce")),
    Template("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("neither", "endorse", "promote")),
    Template("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause", ("bsd", "2", "clause")),
    Template("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause", ("bsd", "3", "clause")),
    Template("GPL-2.0", "SPDX-License-Identifier: GPL-2.0", ("gpl", "2.0")),
    Template("GPL-3.0", "SPDX-License-Identifier: GPL-3.0", ("gpl", "3.0")),
    Template("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1", ("lgpl", "2.1")),
    Template("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", ("gnu", "lesser", "2.1")),
    Template("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("gnu", "lesser", "2.1")),
    Template("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", ("gnu", "lesser", "3")),
    Template("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "affero", "3")),
    Template("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ("permission", "alter", "restrictions")),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", ("boost", "1.0")),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", ("eclipse", "2.0")),
    Template("EUPL-1.2", "Licensed under the European Union Public Licence, version 1.2.", ("european", "union", "1.2")),
    Template("Artistic-2.0", "Licensed under the Artistic License 2.0.", ("artistic", "2.0")),
    Template("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ("cc", "by", "nc", "sa", "4.0")),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "commons", "attribution", "sharealike", "4.0")),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative", "commons", "attribution", "noncommercial", "4.0")),
)
#: Licenses that begin with the same sentence, from the least telling to the most telling notice.
FAMILY = ("BSD-2-Clause OR BSD-3-Clause", "BSD-2-Clause", "BSD-3-Clause")
#: Notices of a family no further apart than this belong to one license text.
FAMILY_GAP = 1_500
#: Words that turn a notice into its opposite when they stand in it or shortly before it.
NEGATIONS = frozenset(("not", "never", "cannot", "neither", "isn", "wasn", "aren", "weren", "nor"))
_SENTENCE_END = re.compile(r"[.!?;:](?=\s)|\n\s*\n")
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
#: Words that no differing wording may hold, since they name another license.
_NAMES = {w for t in TEMPLATES for w in t.own if len(w) <= 3 or w in ("lesser", "affero", "apache", "mozilla", "lgpl", "agpl", "boost", "eclipse", "artistic")} | {"noncommercial", "sharealike", "noderivatives"}


#: The words of a cue may be wrapped, with comment marks between them.
_CUE = re.compile("|".join(re.escape(c).replace(r"\ ", r"\W{1,40}") for c in CUES))
_TOKEN = re.compile(r"\S+")
#: A piece ends between words; only a longer run without white space is cut inside.
LONG_TOKEN = 64


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def lowered(text: str) -> str:
    """``text`` in small letters, each at its place."""
    low = text.lower()
    # some capitals lower to two characters, which would shift places
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def pieces(low: str, start: int, end: int, reach: int = REACH, stretch: int = STRETCH) -> list[tuple[int, int]]:
    """(start, end) of overlapping pieces of ``low[start:end]``; each cue has ``reach`` characters on both sides in one of them.

    So a notice that is no longer than that lies whole in the piece of its cue. White space counts as one character.
    """
    tokens = [m.span() for m in _TOKEN.finditer(low, start, end)]
    firsts = [a for a, _ in tokens]
    flat = list(accumulate((b - a + 1 for a, b in tokens), initial=0))
    total = flat.pop()
    out, upto = [], -1
    for cue in _CUE.finditer(low, start, end):
        k = bisect_right(firsts, cue.start()) - 1
        at = flat[k] + cue.start() - firsts[k]
        if min(at + reach, total) <= upto:
            continue
        begin = max(0, at - reach)
        upto = min(begin + stretch, total)
        k = bisect_right(flat, begin) - 1
        inside = begin - flat[k]
        first = firsts[k] + (inside if inside > LONG_TOKEN else 0)
        k = bisect_right(flat, upto - 1) - 1
        inside = upto - flat[k]
        last = firsts[k] + inside if tokens[k][1] - firsts[k] - inside > LONG_TOKEN else tokens[k][1]
        out.append((first, last))
    return out


def blocks(text: str, reach: int = REACH, stretch: int = STRETCH) -> list[tuple[int, str, bool]]:
    """(start, block, cut): each line that has a cue, and each paragraph of several lines that has one.

    Of a line or paragraph longer than any notice, ``pieces`` are taken instead.
    """
    low = lowered(text)
    if not _CUE.search(low):
        return []
    out, at = [], 0
    for part in text.split("\n\n"):
        if _CUE.search(low, at, at + len(part)):
            inner, lines = at, part.split("\n")
            for line in lines:
                if len(line) <= stretch and _CUE.search(low, inner, inner + len(line)):
                    out.append((inner, line, False))
                inner += len(line) + 1
            if len(part) > stretch:
                out += [(a, text[a:b], True) for a, b in pieces(low, at, at + len(part), reach, stretch)]
            elif len(lines) > 1:
                out.append((at, part, False))
        at += len(part) + 2
    return out


class Scanner:
    """Names a block; holds one compressor per template."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, missing: float = MISSING):
        # raw dictionaries need eight bytes at least; a template shorter than that is padded with spaces
        held = [zstandard.ZstdCompressionDict(t.text.lower().encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for t in templates]
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.given = [zstandard.ZstdCompressor(dict_data=d, **options) for d in held]
        self.templates, self.missing = templates, missing
        self.words = [words(t.text) for t in templates]
        self.reach = max([REACH, *(2 * len(t.text) for t in templates)])
        self.stretch = max(STRETCH, self.reach * 8 // 3)
        self.parts = Cache(self._parts, 20_000)

    def reductions(self, block: str) -> list[float]:
        raw = " ".join(block.lower().split()).encode("utf-8", "replace")
        plain = len(self.alone.compress(raw))
        return [1 - len(c.compress(raw)) / plain for c in self.given]

    def _name(self, block: str):
        own = words(block)
        if not own:
            return None
        falls = self.reductions(block)
        for k in sorted(range(len(falls)), key=lambda i: (-falls[i], i)):
            if falls[k] <= 0:
                break
            added, lost, first, last = self.differences(own, self.words[k])
            template = self.templates[k]
            odd = (_NAMES | NEGATIONS) & set(added)
            if len(lost) <= self.missing * len(self.words[k]) and not (set(lost) & set(template.own)) and not odd:
                return template.name, falls[k], added, lost, first, last
        return None

    def _parts(self, block: str) -> list[tuple]:
        """(name, fall, added, lost, start, end) of every notice in a block, at the place of its own words.

        A notice that is all the block has is placed as the whole block.
        """
        out, rest = [], [(0, lowered(block))]
        while rest:
            at, low = rest.pop()
            answer = self._name(low) if _CUE.search(low) else None
            if answer:
                spans = [m.span() for m in _WORD.finditer(low)]
                start, end = spans[answer[4]][0], spans[answer[5] - 1][1]
                if len(low) == len(block) and answer[4] == 0 and answer[5] == len(spans):
                    start, end = 0, len(low)
                out.append((*answer[:4], at + start, at + end))
                rest += [(at, low[:start]), (at + end, low[end:])]
        return sorted(out, key=lambda x: x[4:])

    @staticmethod
    def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str], int, int]:
        """Words of the part of ``block`` facing the template that it lacks, template words that are not there, and that part."""
        match = difflib.SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks()
        hit = [m for m in match if m.size]
        if not hit:
            return block, template, 0, len(block)
        lost = set(range(len(template))) - {m.b + k for m in hit for k in range(m.size)}
        first, last = hit[0].a, hit[-1].a + hit[-1].size
        inside = set(range(first, last)) - {m.a + k for m in hit for k in range(m.size)}
        return [block[k] for k in sorted(inside)], [template[k] for k in sorted(lost)], first, last

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """The number of candidate blocks, and the confirmed ones."""
        candidates = blocks(text, self.reach, self.stretch)
        # a line is answered before the paragraph around it; the narrower one stands for its license
        found: list[dict] = []
        ends: dict[str, list[tuple[int, int]]] = {}
        for start, block, _ in sorted(candidates, key=lambda c: (c[2], len(c[1]), c[0])):
            for name, fall, added, lost, first, last in ((*a[:4], start + a[4], start + a[5]) for a in self.parts[block]):
                inside = ends.setdefault(name, [])
                k = bisect_left(inside, (first, 0))
                # a line and its paragraph, or pieces that overlap, hold the same notice
                known = k > 0 and inside[k - 1][1] > first or k < len(inside) and inside[k][0] < last
                if not known and not negated(text, first):
                    inside.insert(k, (first, last))
                    found.append({"license": name, "start": first, "length": last - first, "reduction": fall, "added": added, "missing": lost})
        found.sort(key=lambda m: (m["start"], m["length"], m["license"]))
        return len(candidates), settled(found)


def negated(text: str, at: int) -> bool:
    """Whether one of the four words before ``at`` in its sentence denies what follows."""
    before = text[max(0, at - 120) : at].lower()
    ends = list(_SENTENCE_END.finditer(before))
    return not NEGATIONS.isdisjoint(words(before[ends[-1].end() if ends else 0 :])[-4:])


def settled(found: list[dict]) -> list[dict]:
    """Notices of one license text take the name of the most telling one; the opening sentence starts a new text."""
    text: list[dict] = []
    for match in [m for m in found if m["license"] in FAMILY]:
        if text and (match["license"] == FAMILY[0] or match["start"] - text[-1]["start"] - text[-1]["length"] > FAMILY_GAP):
            text = []
        text.append(match)
        name = max((m["license"] for m in text), key=FAMILY.index)
        for m in text:
            m["license"] = name
    return found


MATCH = "array<struct<license:string,start:int,length:int,reduction:double,added:array<string>,missing:array<string>>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, missing: float = MISSING) -> DataFrame:
    """(doc_id, n_blocks, licenses, matches) of every row of ``docs`` (doc_id, text).

    ``n_blocks`` counts candidate blocks, ``licenses`` lists the confirmed names sorted, ``matches`` has place,
    size reduction and differing words of each; the place is that of the notice's own words, or the whole block where
    it has no others. Every notice of a block is named, whatever the block's length. A notice that its sentence denies
    is none. The sentence that two licenses of a family share bears the name of both unless a clause nearby tells
    them apart. Whole texts are scanned. Null and empty texts have no block;
    ties in reduction go to the earlier template; repeated rows are all returned; other columns are not read.
    """
    match = pa.struct(
        [("license", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("reduction", pa.float64()), ("added", pa.list_(pa.string())), ("missing", pa.list_(pa.string()))]
    )

    def run(batches):
        scanner = Scanner(templates, missing)
        for batch in batches:
            count, names, found = [], [], []
            for text in batch.column(1):
                raw = text.as_py() or ""
                n, own = scanner.scan(raw)
                count.append(n), found.append(own), names.append(sorted({m["license"] for m in own}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(found, pa.list_(match))],
                names=["doc_id", "n_blocks", "licenses", "matches"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_blocks long, licenses array<string>, matches {MATCH}")
