"""License scans by conditional compression.

A passage that holds a license notice compresses far better once the compressor has seen the notice. Blocks are whole paragraphs with a cue, which is a
word that some template must have: elsewhere none could be confirmed, so nothing is passed over. In
each, every template is looked up at every place of its rarest telling word; the words around it are compressed alone and with the template
as a zstandard raw dictionary, and where they become smaller, the place is looked for in them. It is confirmed by its exact wording differences: the
words of the template that it lacks, and those it has in their place; and by itself it must become much smaller. Words that tell one license from another (names, numbers, clauses such as
NC) must all be there. Of places that overlap the one with the most words counts, each difference taking two; all others hold, and what is joined to one by "or" or "and" may lack the first words.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._common import in_arrow, read, slices

#: Templates: identifier, wording, and the words that must be in a block, the first of them the one that tells most.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache 2.0"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "restriction permission granted"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "substantial permission portions"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", "gnu general 3 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", "gnu general 2 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", "gnu lesser 3 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", "gnu affero 3 2007"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License.", "bsd 3-clause"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License.", "bsd 2-clause"),
    ("BSD", "Redistribution and use in source and binary forms", "redistribution source binary forms"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "endorse neither contributors"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("ISC", "Released under the ISC License.", "isc"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee permission hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0.", "cc0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
)
#: How licenses are named in sentences, links to their texts, and what a link must hold. All may also be named by their identifiers.
NAMED = (
    ("MIT", "the MIT License", "mit"),
    ("Apache-2.0", "the Apache License, Version 2.0", "apache 2.0"),
    ("GPL-3.0", "the GNU General Public License, version 3", "gnu general 3"),
    ("GPL-2.0", "the GNU General Public License, version 2", "gnu general 2"),
    ("CC-BY-4.0", "CC BY 4.0", "cc by 4.0"),
    ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "creative attribution 4.0"),
    ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "creative attribution sharealike 4.0"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "creative attribution noncommercial 4.0"),
    ("CC-BY-ND-4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License", "creative attribution noderivatives 4.0"),
)
LINKS = (
    *((f"CC-{x.upper()}-4.0", f"creativecommons.org/licenses/{x}/4.0") for x in ("by", "by-sa", "by-nc", "by-nd")),
    ("CC0-1.0", "creativecommons.org/publicdomain/zero/1.0"),
    ("MIT", "opensource.org/licenses/MIT"),
    ("GPL-3.0", "gnu.org/licenses/gpl-3.0"),
    ("GPL-2.0", "gnu.org/licenses/old-licenses/gpl-2.0"),
    ("MPL-2.0", "mozilla.org/MPL/2.0"),
)
_SAID = ("Licensed under", "Released under", "Distributed under", "Licensed under the terms of")
TEMPLATES += tuple((name, f"{start} {said}.", must) for name, said, must in NAMED for start in _SAID if f"{start} {said}." not in [t[1] for t in TEMPLATES])
TEMPLATES += tuple((name, said.removeprefix("the "), must) for name, said, must in NAMED if len(said.split()) > 4)
TEMPLATES += tuple((name, f"{start} {name}", f"{name} {' '.join(more)}") for name in dict.fromkeys(t[0] for t in TEMPLATES if t[0] != "BSD") for start, *more in (("Licensed under",), ("SPDX-License-Identifier:", "spdx")))
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}-{end}", f"{name} spdx {end}") for name in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0") for end in ("or-later", "only"))
TEMPLATES += tuple(
    (name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.", f"gnu redistribute {kind.split()[0]} {n}")
    for name, kind, n in (("GPL-3.0", "General Public License", 3), ("GPL-2.0", "General Public License", 2), ("LGPL-3.0", "Lesser General Public License", 3), ("AGPL-3.0", "Affero General Public License", 3))
)
TEMPLATES += tuple((name, link, link) for name, link in LINKS)
#: A place must shrink by this share with a template; words that may differ.
LEAST_GAIN, MOST_DIFFERENT = 0.35, 0.2
#: A stretch of words is looked at if it shrinks by this share: less than a place must, since it may have other words around the place.
FIND_GAIN = 0.2
#: How notices begin, which one joined to another may lack; what joins them; words that make another license of one that lacks them.
STARTS = ("this work is licensed under", "licensed under the terms of", "licensed under", "released under", "distributed under", "dedicated to", "spdx license identifier")
JOINS, CLAUSES = frozenset(("or", "and")), frozenset("nc nd sa lesser affero sharealike noncommercial noderivatives".split())

_WORD = re.compile(r"[0-9a-z]+(?:\.[0-9a-z]+)*")
_PARAGRAPH = re.compile(r"\n\s*\n")


class Finding(NamedTuple):
    license: str
    gain: float
    differences: str
    block: str


class Template(NamedTuple):
    license: str
    words: list[str]
    must: frozenset[str]
    start: int  # how many words a joined notice may lack
    compressor: zstandard.ZstdCompressor


def words(text: str) -> list[str]:
    return [w.removeprefix("www.") for w in _WORD.findall(text.lower())]


#: The first words that templates must have: where none of them is, no template can be.
CUE = rf"(?i)(?<![0-9a-z])(?:{'|'.join(sorted({re.escape(words(must)[0]) for _, _, must in TEMPLATES}))})(?![0-9a-z])"
_CUE = re.compile(CUE)


def _compressor(**more) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False), **more)


@lru_cache(maxsize=1)
def _templates() -> tuple[zstandard.ZstdCompressor, int, list[Template]]:
    """The plain compressor, the bytes of an empty frame, and the templates with their dictionaries; made once for each worker."""
    plain = _compressor()
    made = []
    for name, text, must in TEMPLATES:
        w = words(text)
        start = next((len(x.split()) for x in STARTS if w[: len(x.split())] == x.split()), 0)
        made.append(Template(name, w, frozenset(words(must)), start, _compressor(dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))))
    return plain, len(plain.compress(b"")), made


def differences(block: list[str], template: list[str]) -> tuple[int, str, int, int]:
    """How many words differ between a template and the stretch of the block that it matches, and which: -gone +new; and where the stretch begins and ends."""
    match = difflib.SequenceMatcher(None, template, block, autojunk=False)
    same = [m for m in match.get_matching_blocks() if m.size]
    if not same:
        return len(template), "", 0, 0
    first, last = max(0, same[0].b - same[0].a), min(len(block), same[-1].b + len(template) - same[-1].a)
    out, n = [], 0
    for kind, a, b, c, d in difflib.SequenceMatcher(None, template, block[first:last], autojunk=False).get_opcodes():
        if kind != "equal":
            n += max(b - a, d - c)
            out += [f"-{w}" for w in template[a:b]] + [f"+{w}" for w in block[first:last][c:d]]
    return n, " ".join(out), first, last


def blocks(text: str) -> Iterator[str]:
    """The paragraphs with a cue, whole."""
    return (block for block in _PARAGRAPH.split(text) if _CUE.search(block))


class Place(NamedTuple):
    n: int
    first: int
    last: int
    finding: Finding


def _gain(tokens: list[str], template: list[str], compressor: zstandard.ZstdCompressor) -> float:
    plain, empty, _ = _templates()
    passage = " ".join(tokens).encode()
    alone = len(plain.compress(passage)) - empty
    return (alone - (len(compressor.compress(passage)) - empty)) / max(1, min(alone, len(" ".join(template))))


def _place(tokens: list[str], low: int, high: int, t: Template, wanted: list[str]) -> Place | None:
    """Where the words ``wanted`` of a template are in a stretch of a block that compression with the template finds, if they hold."""
    low = max(0, low)
    lacking = t.words[: t.start] * (len(wanted) < len(t.words))  # too few words by themselves show nothing
    if _gain(lacking + tokens[low:high], t.words, t.compressor) < FIND_GAIN:
        return None
    n, what, first, last = differences(tokens[low:high], wanted)
    here = tokens[low + first : low + last]
    if n > MOST_DIFFERENT * len(wanted) or not t.must <= {*here, *t.words[: len(t.words) - len(wanted)]} or not CLAUSES.isdisjoint(set(here) - set(t.words)):
        return None
    gain = _gain(lacking + here, t.words, t.compressor)
    return Place(n, low + first, low + last, Finding(t.license, gain, what, "")) if gain >= LEAST_GAIN else None


def places(tokens: list[str]) -> list[Place]:
    """All notices of a block; none of them overlap."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(tokens):
        at.setdefault(w, []).append(i)
    held = [t for t in _templates()[2] if t.must - set(t.words[: t.start]) <= at.keys()]
    found = []
    for t in held:
        size, slack = len(t.words), int(MOST_DIFFERENT * len(t.words))
        if not t.must <= at.keys():
            continue
        rare = min(t.must, key=lambda w: (len(at[w]), w))
        for i in at[rare]:
            low = i - t.words.index(rare)
            found += [p for more in range(0, slack + 1, max(1, slack)) if (p := _place(tokens, low - more, low + size + more, t, t.words))]
    kept: list[Place] = []
    for p in sorted(found, key=lambda p: (2 * p.n + p.first - p.last, p.n, p.first, p.finding.license)):
        if all(p.last <= k.first or p.first >= k.last for k in kept):
            kept.append(p)
    ends = [k.last for k in kept]
    while ends:  # what is joined to a notice, and so on along the list
        end = ends.pop()
        after = end
        while after < len(tokens) and tokens[after] in JOINS:
            after += 1
        if after == end:
            continue
        joined = [p for t in held if t.start for skip in (0, 1) if (p := _place(tokens, after, after + len(t.words) - t.start, t, t.words[t.start + skip * (t.words[t.start] == "the") :]))]
        joined = [p for p in joined if p.first == after and all(p.last <= k.first or p.first >= k.last for k in kept)]
        if joined:
            kept.append(min(joined, key=lambda p: (p.n, p.first - p.last, p.finding.license)))
            ends.append(kept[-1].last)
    return kept


def scan(text: str) -> list[Finding]:
    """The licenses of a text, each once, with its best place."""
    found: dict[str, tuple[int, Finding]] = {}
    for block in blocks(text):
        spans = [m.span() for m in _WORD.finditer(block.lower())] if len(block.lower()) == len(block) else []
        for p in places(words(block)):
            f = p.finding._replace(block=block[spans[p.first][0] : spans[p.last - 1][1]] if spans else block)
            if f.license not in found or p.n < found[f.license][0]:
                found[f.license] = (p.n, f)
    return [found[k][1] for k in sorted(found)]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text: ``id_col``, ``licenses`` (an array of identifiers), and ``gains``, ``differences`` and ``blocks`` beside them.

    Texts without a cue, null and empty ones among them, have empty arrays; they never leave the JVM. Rows are kept one for one, null ids too;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [scan(t) if t else [] for t in part.column(1).to_pylist()]
            columns = [pa.array([[f[k] for f in x] for x in found], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "licenses", "gains", "differences", "blocks"])

    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.when(text.rlike(CUE), text).alias("text"))
    out = in_arrow(slim, run, "id long, licenses array<string>, gains array<double>, differences array<string>, blocks array<string>")
    return out.withColumnRenamed("id", id_col)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.array_join("differences", "; ").alias("differences"))
