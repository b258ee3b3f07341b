"""License scan by conditional compression.

A block of text that quotes a license notice compresses much better when the
notice is the compressor's dictionary.  Candidate blocks are compressed with
every template as a raw zstandard dictionary, the size reductions are ranked,
and the best templates are confirmed, or not, by their exact differences of
wording from the block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Usual wordings of license notices, by license name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "Proprietary": ("All rights reserved. No part of this work may be reproduced without permission.",),
}

#: Whole license texts, without copyright lines.
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
FULL_TEXTS: dict[str, str] = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "BSD-3-Clause": _CONDITIONS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _DISCLAIMER,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
}
TEMPLATES = {name: (*TEMPLATES.get(name, ()), *([FULL_TEXTS[name]] if name in FULL_TEXTS else [])) for name in dict.fromkeys([*TEMPLATES, *FULL_TEXTS])}

_WORDS = re.compile(r"[a-z]+(?:[-'][a-z]+)*|\d+(?:\.\d+)*|cc0").findall
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def blocks(parts: list[list[str]], around: int, cue: re.Pattern | None, gap: int = 2) -> Iterator[tuple[int, int]]:
    """(start, stop) in the words of all parts, sentences and lines: those with a cue (without `cue`: all), and groups of them over at most `gap` others.

    Groups are widened by `around` words on both sides, across line feeds and
    abbreviations, and cut into half overlapping pieces that hold any notice of
    `around` words whole.
    """
    at = [0]
    for p in parts:
        at.append(at[-1] + len(p))
    cues = [i for i, p in enumerate(parts) if cue is None or cue.search(" ".join(p))]
    longest, k = max(120, 2 * around), 0
    while k < len(cues):
        first = k
        while k + 1 < len(cues) and cues[k + 1] - cues[k] <= gap + 1:
            k += 1
        for i in cues[first : k + 1]:
            if at[i + 1] - at[i] <= longest:
                yield at[i], at[i + 1]
        start, stop = max(0, at[cues[first]] - around), min(at[-1], at[cues[k] + 1] + around)
        for x in range(start, max(start + 1, stop - longest // 2), longest // 2):
            yield x, min(stop, x + longest)
        k += 1


def notices(text: str, known: Callable[[str], dict | None], around: int, cue: re.Pattern | None) -> list[tuple[int, str, dict]]:
    """(number, block, match): the notices of a text in order; of overlapping ones with one license the best."""
    parts = [p.split() for p in _SENTENCES.split(text) if p.strip()]
    flat = [w for p in parts for w in p]
    found, seen = [], set()
    todo = list(blocks(parts, around, cue))[::-1]
    number = 0
    while todo:
        start, stop = todo.pop()
        if (start, stop) in seen or stop <= start:
            continue
        seen.add((start, stop))
        block = " ".join(flat[start:stop])
        if cue is not None and not cue.search(block):
            continue
        got = known(block)
        if got:
            ends = np.cumsum([len(words(w)) for w in flat[start:stop]])
            low, high = got["span"]
            a, b = start + int(np.searchsorted(ends, low, side="right")), start + int(np.searchsorted(ends, high, side="left")) + 1
            found.append((got["rank"], number, a, b, block, got))
            todo += [(b, stop), (start, a)]  # what else the block holds
        number += 1
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (f[0], f[1])):
        if not any(f[5]["license"] == g[5]["license"] and f[2] < g[3] and g[2] < f[3] for g in kept):
            kept.append(f)
    return [(f[1], f[4], f[5]) for f in sorted(kept, key=lambda f: f[2])]


@lru_cache(maxsize=8)
def _compressors(templates: tuple[tuple[str, str], ...], level: int = 19):
    made = []
    for name, t in templates:
        raw = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, t, words(t), zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False)))
    return made, zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)


class Bound:
    """Whether some words can hold a notice at all: of a template at most the tolerated share of words may be missing, and no number.

    Word-by-word comparison never matches more words than the two sides have in
    common, so nothing that `match` would confirm is ruled out.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...], tolerance: float) -> None:
        self.needs = []
        for _, t in templates:
            own = words(t)
            self.needs.append((Counter(own), len(own) - int(tolerance * len(own) + 1e-9), {w for w in own if w[0].isdigit()}))
        self.words = {w for own, *_ in self.needs for w in own}

    def __call__(self, found: list[str]) -> bool:
        have = Counter(w for w in found if w in self.words)
        return any(numbers <= have.keys() and sum(min(n, have[w]) for w, n in own.items() if w in have) >= least for own, least, numbers in self.needs)


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Template words that the block lacks, and block words put between the matched ones."""
    missing, added = [], []
    ops = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    for k, (tag, a, b, c, d) in enumerate(ops):
        if tag in ("delete", "replace"):
            missing += template[a:b]
        if tag in ("insert", "replace") and 0 < k < len(ops) - 1:
            added += block[c:d]
    return missing, added


def match(block: str, templates: tuple[tuple[str, str], ...], ranked: int = 3, tolerance: float = 0.1) -> dict | None:
    """The license that a block quotes, or None.

    The templates with the `ranked` largest size reductions, and all that tie
    with the last of them, are compared word by word; missing and added words
    together may be `tolerance` of the template, and a number of the template
    may never be missing.  Fewest differences win, then the largest reduction,
    then the longer template, then the name.
    """
    made, plain = _compressors(templates)
    raw = block.encode("utf-8", "surrogatepass")
    alone = len(plain.compress(raw))
    sizes = [alone - len(c.compress(raw)) for *_, c in made]
    least = sorted(sizes, reverse=True)[: max(1, ranked)][-1]
    own = words(block)
    best = None
    for (name, text, template, _), gain in zip(made, sizes):
        if gain <= 0 or gain < least:
            continue
        missing, added = differences(template, own)
        if len(missing) + len(added) > tolerance * len(template) or any(w[0].isdigit() for w in missing) or any(w[0].isdigit() for w in added):
            continue
        rank = (len(missing) + len(added), -gain, -len(template), name)
        if best is None or rank < best[0]:
            same = [m for m in SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks() if m.size]
            span = (same[0].b, same[-1].b + same[-1].size)
            best = (rank, {"rank": rank, "span": span, "license": name, "template": text, "alone": alone, "reduction": gain, "missing": missing, "added": added})
    return best and best[1]


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, doc_id: str = "doc_id", text: str = "text", tolerance: float = 0.1, ranked: int = 3, cue: str | None = None) -> DataFrame:
    """(doc_id, block_no, block, license, template, alone, reduction, missing, added): confirmed notices, one row each.

    `alone` is the block's compressed size, `reduction` what the template saves
    of it.  Of overlapping notices with the same license only the best comes out,
    separate ones come out each; null and empty texts have none; repeated rows come out each; a null
    doc_id stays null.  Other columns are dropped.  An empty table gives no rows.

    Texts and blocks with too few words of every template to be within the
    tolerance are passed over, which loses nothing (see `Bound`); with `cue`, also
    those that don't match that pattern.  The templates of the `ranked` largest reductions are compared word by word;
    `ranked` = the number of templates compares all.  Nothing is shuffled.
    """
    flat = tuple((name, t) for name, ts in (TEMPLATES if templates is None else templates).items() for t in ts)
    around = max((len(t.split()) for _, t in flat), default=0)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    rows = rows.where(F.col("text").rlike(cue)) if cue else rows
    pattern = re.compile(cue) if cue else None
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, block_no int, block string, license string, template string, alone int, reduction int, missing array<string>, added array<string>"
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        possible = Bound(flat, tolerance)

        @lru_cache(maxsize=10_000)
        def known(block: str) -> dict | None:
            return match(block, flat, ranked, tolerance) if possible(words(block)) else None

        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                for number, block, got in notices(text, known, around, pattern) if possible(words(text)) else ():
                    at.append(i)
                    found.append((number, block, *[got[c] for c in schema_names[3:]]))
            columns = zip(*found) if found else ([] for _ in types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))], schema_names)

    schema_names = ["doc_id", "block_no", "block", "license", "template", "alone", "reduction", "missing", "added"]
    return rows.mapInArrow(find, schema)
