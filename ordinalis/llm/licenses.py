"""License scans by conditional compression.

A block is compressed alone and with each template as a raw zstandard dictionary. A template that the block repeats saves most of its bytes, so
savings rank the templates. The exact differences of wording confirm: none may touch a word that tells licenses apart, and few words may be missing
or added. Of confirmed templates the one with the fewest words changed wins, then the largest saving; if none is, the largest saving, unconfirmed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Wordings of public licenses, by SPDX name: whole texts of the short ones, notices of those that are named. A name may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
)
#: Texts without one of these have no candidate block.
CUES = r"(?i)licen[cs]|permission|redistribut|public\W+domain|copyright|free\W+software|creative\W+commons"
#: Share of the compressed size that a template must save, and share of its words that the block must have, in order.
MIN_SAVING, MIN_WORDS_FOUND = 0.30, 0.90
#: Least overlap, in characters, of the windows that longer blocks are looked at in; it is the longest template's length if that is more, and windows are twice as long.
OVERLAP_CHARS = 600
#: Share of a template's words that a place in a text must have, in order, to be a block by itself.
MIN_WORDS_NEAR = 0.75
WORD = re.compile(r"(?i)gnu\s+library\b|[\w.+-]*\w")
BREAK = re.compile(r"[.!?;]\s|\n\s*\n")
#: Numbers of list items before the clauses of a license aren't words.
ITEM = re.compile(r"(?im)^[^\w\n]*\(?\d[.)]\s+(?=redistribution|neither|all advertising|the origin|altered source|this notice)")
#: Words that tell licenses or conditions apart: names, kinds, clauses, denials. A difference with one of them, or in numbers, isn't confirmed.
NAMES = frozenset("mit apache gnu general public mozilla eclipse bsd isc unlicense creative commons cc cc0 attribution international unported artistic academic gpl agpl lgpl mpl epl license licence source code form free domain".split())
TELLING = (NAMES - frozenset("license licence source code form free general public international domain".split())) | frozenset("affero lesser by sa nc nd noncommercial commercial noderivatives noderivs derivatives derivs sharealike alike share neither nor endorse advertising acknowledgement not no non never without except only proprietary prohibited forbidden restricted unlicensed".split()) | {"gnu library"}
#: These, as one of the two words before a notice, deny it.
DENIALS = frozenset({"not", "never", "no", "nor", "neither", "without"})
#: Inserted words that change no meaning; others count as much as missing ones.
FILLER = frozenset("the a an of and or to in on by as is are be this that these its it terms conditions hereby software program work file library version v".split())


def blocks(text: str, overlap: int = OVERLAP_CHARS) -> Iterator[tuple[int, int]]:
    """Candidate blocks of a text, as character ranges: paragraphs with a cue, lines with a cue in paragraphs of several lines, and
    sentences with a cue in longer lines. Long blocks come as overlapping windows. Notices inside other text are found by Notices."""
    cue, size = re.compile(CUES), 2 * overlap
    seen: set[tuple[int, int]] = set()
    for paragraph in re.finditer(r"(?:[^\n]+\n?)+", text):
        if not cue.search(paragraph[0]):
            continue
        lines = [(paragraph.start() + m.start(), paragraph.start() + m.end()) for m in re.finditer(r"[^\n]+", paragraph[0])]
        found = [(paragraph.start(), paragraph.end())] if len(paragraph[0]) <= size else [(a, min(a + size, paragraph.end())) for a in range(paragraph.start(), paragraph.end(), overlap)]
        for a, b in lines:
            found += [(a, b)] if b - a <= size else []
            found += [(a + m.start(), a + m.end()) for m in re.finditer(r"\S(?:[^.!?]|[.!?](?!\s+[A-Z]))*[.!?]?", text[a:b])]
        for a, b in found:
            if (a, b) not in seen and b - a <= size and cue.search(text, a, b):
                seen.add((a, b))
                yield a, b


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def parts(found: list[str]) -> set[str]:
    """The words and, of those with hyphens, their parts."""
    return {x for w in found for x in (w, *w.split("-"))}


def plain(word: str) -> str:
    """A number without the marks that change nothing: v2.0 is 2."""
    return re.sub(r"(?:\.0)+$", "", word.removeprefix("v")) if re.search(r"\d", word) else word


def numbers(found: list[str]) -> list[str]:
    return [plain(w) for w in found if re.search(r"\d", w)]


def telling(a: list[str], b: list[str], before: str, after: str, own: set[str]) -> bool:
    """Whether a change of the words a, between the template's words before and after, to b tells another license or another condition."""
    if numbers(a) != numbers(b) or parts(a) & TELLING or parts(b) & TELLING - own:
        return True
    return not a and before in NAMES and after in NAMES  # words inside a name


def differences(name: str, template: str, block: str, before: str = "") -> tuple[float, list[str], bool]:
    """Share of the template's words that the block has in order; every change between its first and last of them, "template words > block words"; and
    whether the block is confirmed: no change is telling, the words before don't deny it, and of the template's words and those that are added few are
    missing or added."""
    a, b = words(template), words(ITEM.sub("", block))
    ops = SequenceMatcher(None, [*map(plain, a)], [*map(plain, b)], autojunk=False).get_opcodes()
    lead = words(before)
    while ops and ops[0][0] == "insert":
        lead += b[ops[0][3] : ops[0][4]]
        ops = ops[1:]
    while ops and ops[-1][0] == "insert":
        ops = ops[:-1]
    found = sum(i2 - i1 for op, i1, i2, _, _ in ops if op == "equal")
    changed = [(i1, i2, j1, j2) for op, i1, i2, j1, j2 in ops if op != "equal"]
    added = sum(max(0, sum(w not in FILLER for w in b[j1:j2]) - (i2 - i1)) for i1, i2, j1, j2 in changed)
    own = set(name.lower().split("-"))
    same = not DENIALS.intersection(lead[-2:]) and not any(telling(a[i1:i2], b[j1:j2], a[i1 - 1] if i1 else "", a[i2] if i2 < len(a) else "", own) for i1, i2, j1, j2 in changed)
    return found / max(1, len(a)), [f"{' '.join(a[i1:i2])} > {' '.join(b[j1:j2])}" for i1, i2, j1, j2 in changed], same and found >= MIN_WORDS_FOUND * (len(a) + added)


def cues(text: str, found: list[tuple[int, int, str]]) -> list[int]:
    """Numbers of the words, of those found in the text, where cues begin."""
    starts = [a for a, _, _ in found]
    return sorted({bisect_right(starts, m.start()) - 1 for m in re.finditer(CUES, text)} - {-1})


class Notices:
    """Places of a text that have most of a template's words around a cue, wherever blocks end, as character ranges."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.templates = []
        for _, t in templates:
            found = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(t)]
            if found:
                self.templates.append(([w for *_, w in found], {w for *_, w in found}, cues(t, found), t[found[-1][1] :]))

    def __call__(self, text: str) -> Iterator[tuple[int, int]]:
        found = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
        at = cues(text, found)
        for template, distinct, places, tail in self.templates:
            n, slack = len(template), 2 + len(template) // 5
            firsts, tried = sorted({k - place for k in at for place in places}), set()
            for first in firsts:
                a = max(0, first - slack)
                window = [w for *_, w in found[a : max(0, first + n + slack)]]
                if first in tried or len(distinct.intersection(window)) < MIN_WORDS_NEAR * len(distinct):
                    continue
                tried.add(first)
                same = [m for m in SequenceMatcher(None, template, window, autojunk=False).get_matching_blocks() if m.size]
                longest = max(same, key=lambda m: m.size)
                if a + longest.b - longest.a != first:  # looked at again from where the template would begin
                    if a + longest.b - longest.a not in tried:
                        firsts.append(a + longest.b - longest.a)
                    continue
                if sum(m.size for m in same) < MIN_WORDS_NEAR * n:
                    continue
                last, missing = a + same[-1].b + same[-1].size - 1, n - same[-1].a - same[-1].size
                while missing and last + 1 < len(found) and not BREAK.search(text, found[last][1], found[last + 1][0]):
                    last, missing = last + 1, missing - 1  # other words in place of the template's last ones, up to the sentence's end
                start, end = found[a + same[0].b][0], found[last][1]
                yield start, end + next(k for k in range(len(tail), -1, -1) if text.startswith(tail[:k], end))


class Ranker:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        import zstandard as z

        if odd := [t for _, t in templates if not re.search(CUES, t)]:
            raise ValueError(f"no text without a cue is looked at, and this template has none: {odd[0][:60]}")
        self.templates, self.alone, self.notices = templates, z.ZstdCompressor(level=3), Notices(templates)
        self.overlap = max(OVERLAP_CHARS, *(len(t) for _, t in templates))
        self.given = [z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for _, t in templates]

    def __call__(self, block: str) -> tuple[int, list[tuple[float, int]]]:
        """The size alone, and (saving, template) by falling saving; equal savings by template order."""
        data = block.encode()
        size = len(self.alone.compress(data))
        return size, sorted(((1 - len(c.compress(data)) / size, i) for i, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))


def scan_text(text: str, rank: Ranker) -> list[tuple]:
    """(start, end, license, template, saving, runner_up, words_found, differences, confirmed) of the blocks with a winner.

    A block has a winner if a template saves MIN_SAVING; a place of Notices also if its words are confirmed, as short notices save little.
    Of blocks that overlap, a confirmed one stays before others, then the one with the larger saving; of equal ones the first, then the shorter.
    """
    rows = []
    places = dict.fromkeys(blocks(text, rank.overlap), MIN_SAVING) | dict.fromkeys(rank.notices(text), -math.inf)
    for (a, b), least in places.items():
        _, ranked = rank(text[a:b])
        if ranked[0][0] < least:
            continue
        compared = [(saving, i, differences(*rank.templates[i], text[a:b], text[max(0, a - 40) : a])) for saving, i in ranked if saving >= least]
        # of confirmed ones that with the fewest words changed, then the largest saving
        agreed = [c for c in compared if c[2][2]]
        saving, best, (share, changes, confirmed) = min(agreed, key=lambda c: sum(len(x.split()) - 1 for x in c[2][1])) if agreed else compared[0]
        if saving < MIN_SAVING and not confirmed:
            continue
        name = rank.templates[best][0]
        other = next((rank.templates[i][0] for _, i in ranked if rank.templates[i][0] != name), None)
        rows.append((a, b, name, best, saving, other, share, changes, confirmed))
    kept: list[tuple] = []
    for r in sorted(rows, key=lambda r: (not r[8], -r[4], r[0], r[1] - r[0])):
        if all(r[1] <= k[0] or r[0] >= k[1] for k in kept):
            kept.append(r)
    return sorted(kept)


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """key, start, end (characters), license, template, saving, runner_up, words_found, differences, confirmed: one row per block with a winner.

    Null and empty texts, and texts without a cue, give no row; every template has a cue, so a notice is passed over only where all of its cues
    are spelled otherwise; repeated rows give their rows each. Other columns aren't read. Nothing
    is shuffled, and a task holds one batch of texts.
    """
    bounded_batches(df.sparkSession)
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("text").rlike(CUES))
    schema = f"`{key}` {source.schema['key'].dataType.simpleString()}, start long, end long, license string, template int, saving double, runner_up string, words_found double, differences array<string>, confirmed boolean"

    names = [key, "start", "end", "license", "template", "saving", "runner_up", "words_found", "differences", "confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Ranker(templates)  # a caller's templates of any length fit the windows
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
        for batch in batches:
            rows = [(k, *r) for k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in scan_text(text, rank)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([batch.schema.field(0).type, *types])], names=names)

    return source.mapInArrow(run, schema)


def op1(df: DataFrame) -> DataFrame:
    found = license_scan(df)
    return found.select("doc_id", "start", "end", "license", "template", F.round("saving", 6).alias("saving"), "runner_up", F.round("words_found", 6).alias("words_found"), F.size("differences").cast("long").alias("n_differences"), F.array_join("differences", "; ").alias("differences"), "confirmed")
