"""License scans by conditional compression.

A block that looks like a license statement is compressed with zstandard twice over: by itself, and
with a template as raw dictionary. The more of its wording the template has, the less is left to
write, so templates are ranked by the relative reduction. All above the bar are confirmed on the words
themselves: the edit script between the block and the closest wording of the template gives the words
that are missing, added and changed, and a winner must keep ``min_kept`` of the wording's words. Where
the whole block stays under the bar, the part of it that a wording covers is measured instead, so
that text around a notice doesn't hide it.

There are two kinds of template. Notices are single sentences, headings and SPDX tags; their blocks are the
sentences with a cue word of runs of lines with one. Bodies are whole license texts and the standard
notices at the head of files; their blocks are paragraphs with a phrase of such texts, and what lies around one
is compared with the whole body. All licenses of a block are reported, the second and later ones only by
words of their own, such as a name or a version, that none before has used. A notice inside a body, or
beside one of the same license, is part of it. A compiled test for the cues turns other texts away first.
Everything happens where the text is; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.license_texts import BODIES
from palimpsest.llm.names import named
from palimpsest.storage import ship

#: Known wordings by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Distributed under the MIT license, see LICENSE for more information."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This project is licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "Released under the GPLv3 license."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", "Released under the GPLv2 license."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL v3."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL v2.1 license."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL v3 license."],
    "MPL-2.0": ["This work is licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0 license."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the Simplified BSD License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the New BSD License."],
    "ISC": ["Licensed under the ISC License.", "Released under the ISC license."],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0."],
    "WTFPL": ["Released under the WTFPL license.", "Licensed under the WTFPL."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License 1.0."],
    "Zlib": ["Released under the zlib license.", "Licensed under the zlib/libpng License."],
    "0BSD": ["Licensed under the BSD Zero Clause License.", "Released under the 0BSD license."],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
    "Proprietary": ["Copyright. All rights reserved.", "All rights reserved.", "All rights reserved. No part may be reproduced without permission."],
}
#: How each license is called in headings, and beside another one.
_CALLED = {
    "MIT": ["MIT", "Expat"], "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache License, Version 2.0"], "GPL-3.0": ["GPL-3.0", "GPLv3", "GPL v3"], "GPL-2.0": ["GPL-2.0", "GPLv2", "GPL v2"], "AGPL-3.0": ["AGPL-3.0", "AGPLv3", "AGPL v3"],
    "LGPL-2.1": ["LGPL-2.1", "LGPLv2.1", "LGPL v2.1"], "LGPL-3.0": ["LGPL-3.0", "LGPLv3", "LGPL v3"], "MPL-2.0": ["MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0"], "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause"], "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause"],
    "ISC": ["ISC"], "EPL-2.0": ["EPL-2.0", "EPL 2.0"], "CC-BY-4.0": ["CC-BY-4.0", "CC BY 4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "CC BY-SA 4.0"], "CC0-1.0": ["CC0-1.0", "CC0 1.0"], "WTFPL": ["WTFPL"], "BSL-1.0": ["BSL-1.0", "Boost"], "Zlib": ["zlib"], "0BSD": ["0BSD"], "Unlicense": ["Unlicense"],
}
for _name, _calls in _CALLED.items():
    TEMPLATES[_name] += [f"SPDX-License-Identifier: {_name}", *(c if "License" in c else f"The {c} License" for c in _calls)]
#: How each is written after another license.
BESIDES = {n: [x for c in calls for x in ([f"or {c}"] if "License" in c else [f"or {c}", f"or the {c} License"])] for n, calls in _CALLED.items()}
CUES = r"(?i)licen[sc]e|copyright|all rights reserved|public domain|spdx|\bgpl|creative commons|\bcc0\b|hereby granted|provided .?as.is"
_CUE = re.compile(CUES)
#: Phrases of which every body has one in its first paragraph.
_BODY_CUE = re.compile(r"(?i)hereby\s+granted|redistribution\s+and\s+use|terms\s+and\s+conditions\s+for\s+use|provided\s+.?as.is|free\s+software|unencumbered|you\s+may\s+not\s+use|subject\s+to\s+the\s+terms")
_WORD = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")
MIN_REDUCTION, MIN_KEPT = 0.15, 0.6
#: Of a body: the reduction of its paragraph, its words, and those of its first paragraph.
BODY_REDUCTION, BODY_KEPT, GRANT_KEPT = 0.3, 0.45, 0.5
#: Characters between a body and a notice of the same license that belongs to it.
BESIDE = 300
#: Words that don't tell licenses apart.
_GLUE = frozenset(_WORD.findall("released licensed distributed dedicated under the terms of this project work is to a in see for more information license version general public gnu creative commons cc international or and spdx-license-identifier"))
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?](?!\s)[^.!?]*)*(?:[.!?]+|$)")
OUT = "doc_id long, char_from int, char_to int, license string, reduction double, wording int, kept double, n_missing int, n_added int, n_changed int, exact boolean"


def lines_of(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for line in text.split("\n"):
        yield at, at + len(line)
        at += len(line) + 1


def blocks(text: str) -> list[tuple[int, int, int]]:
    """[from, to) of candidate blocks, the sentences with a cue of runs of lines with one, and the end of the sentence that follows in the run.

    A run also has the line before it, if no sentence ends there, and the line after it, if the run ends within one.
    """
    runs: list[tuple[int, int]] = []
    last, cued = (0, 0), False
    for at, end in lines_of(text):
        cue = bool(_CUE.search(text, at, end))
        before = text[last[0] : last[1]].rstrip()
        goes_on = bool(before) and before[-1] not in ".!?:" and end > at
        if cue and runs and runs[-1][1] >= at - 1:
            runs[-1] = (runs[-1][0], end)
        elif cue:
            runs.append((last[0] if goes_on else at, end))
        elif cued and goes_on:
            runs[-1] = (runs[-1][0], end)
        last, cued = (at, end), cue
    out = []
    for a, b in runs:
        cut = [(a + m.start() + len(m.group()) - len(m.group().lstrip()), a + m.end()) for m in _SENTENCE.finditer(text[a:b]) if m.group().strip()]
        for k, (x, y) in enumerate(cut):
            if _CUE.search(text, x, y):
                out.append((x, y, cut[k + 1][1] if k + 1 < len(cut) else y))
    return out


def paragraphs(text: str) -> list[tuple[int, int]]:
    """[from, to) of runs of lines that have words, and so not only the marks of a comment."""
    out: list[tuple[int, int]] = []
    joined = False
    for at, end in lines_of(text):
        some = bool(_WORD.search(text, at, end))
        if some and joined:
            out[-1] = (out[-1][0], end)
        elif some:
            out.append((at, end))
        joined = some
    return out


def differences(wording: list[str], words: list[str]) -> tuple[int, int, int, int]:
    """(kept, missing, added, changed) words, those around the wording left out."""
    kept = missing = added = changed = 0
    for op, i, j, c, d in SequenceMatcher(None, wording, words, autojunk=False).get_opcodes():
        if op == "equal":
            kept += j - i
        elif op == "delete":
            missing += j - i
        elif op == "insert":
            added += (d - c) if 0 < i < len(wording) else 0
        else:
            changed += max(j - i, d - c) if 0 < i and j < len(wording) else j - i
    return kept, missing, added, changed


class Bodies:
    """Compressors by body, made once a worker."""

    def __init__(self, level: int = 3):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.given, self.words, self.grants = [], [], []
        for _, body in BODIES:
            d = zstandard.ZstdCompressionDict(body.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.given.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.words.append([w.lower() for w in _WORD.findall(body)])
            self.grants.append(min(len(self.words[-1]), 20))

    def found(self, text: str) -> list[tuple]:
        """Rows as ``Ranker.found``, with wording -1, of the bodies in a text."""
        seeds = [(a, b) for a, b in paragraphs(text) if _BODY_CUE.search(text, a, b)]
        if not seeds:
            return []
        at = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
        words, starts = [w for w, _ in at], [s for _, (s, _) in at]
        out, done = [], 0
        for a, b in seeds:
            if a < done:
                continue
            i, j = bisect_left(starts, a), bisect_left(starts, b)
            part = text[a:b].lower().encode("utf-8", "replace")
            alone = max(1, len(self.plain.compress(part)))
            best = None
            for k, c in enumerate(self.given):
                reduction = 1 - len(c.compress(part)) / alone
                if reduction < BODY_REDUCTION:
                    continue
                body, lo, hi = self.words[k], max(0, i - len(self.words[k]) // 4), min(len(words), max(j, i + len(self.words[k]) * 3 // 2))
                there = set(zip(words[lo:hi], words[lo + 1 : hi], words[lo + 2 : hi]))
                grams = list(zip(body, body[1:], body[2:]))
                if sum(g in there for g in grams) < 0.25 * len(grams):
                    continue
                same = [x for x in SequenceMatcher(None, body, words[lo:hi], autojunk=False).get_matching_blocks() if x.size >= 3]
                if not same:
                    continue
                lo, hi = lo + same[0].b, lo + same[-1].b + same[-1].size
                kept, missing, added, changed = differences(body, words[lo:hi])
                grant = sum(x.size for x in SequenceMatcher(None, body[: self.grants[k]], words[lo : lo + 2 * self.grants[k]], autojunk=False).get_matching_blocks())
                if kept < BODY_KEPT * len(body) or grant < GRANT_KEPT * self.grants[k]:
                    continue
                rank = ((kept - added - changed) / len(body), kept, reduction)
                if best is None or rank > best[0]:
                    end = at[hi - 1][1][1]
                    end += text[end : end + 1] == "."
                    best = (rank, (at[lo][1][0], end, BODIES[k][0], round(reduction, 6), -1, round(kept / len(body), 6), missing, added, changed, missing + added + changed == 0))
            if best is not None:
                out.append(best[1])
                done = best[1][1]
        return out


class Ranker:
    """Compressors by template, made once a worker."""

    def __init__(self, level: int = 3):
        self.names = list(TEMPLATES)
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.given = []
        for name in self.names:
            raw = "\n".join(TEMPLATES[name] + BESIDES.get(name, [])).lower().encode()
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.given.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.words = [[_WORD.findall(w.lower()) for w in TEMPLATES[n] + BESIDES.get(n, [])] for n in self.names]
        self.own = [[set(w) - _GLUE for w in wordings] for wordings in self.words]

    def reductions(self, block: str) -> list[tuple[float, int]]:
        """(relative reduction, template) from the largest."""
        b = block.lower().encode("utf-8", "replace")
        alone = max(1, len(self.plain.compress(b)))
        return sorted(((1 - len(c.compress(b)) / alone, k) for k, c in enumerate(self.given)), key=lambda r: (-r[0], r[1]))

    def covered(self, block: str, k: int, wording: list[str], spans: list[tuple[int, int]], words: list[str]):
        """(reduction, first word, last word and one) of the part of a block that is closest to a wording."""
        m = SequenceMatcher(None, wording, words, autojunk=False).find_longest_match()
        if not m.size:
            return 0.0, 0, 0
        lo, hi = max(0, m.b - 2 * m.a), min(len(words), m.b + m.size + 2 * (len(wording) - m.a - m.size))
        same = [x for x in SequenceMatcher(None, wording, words[lo:hi], autojunk=False).get_matching_blocks() if x.size]
        lo, hi = lo + same[0].b, lo + same[-1].b + same[-1].size
        part = block[spans[lo][0] : spans[hi - 1][1]].lower().encode("utf-8", "replace")
        return 1 - len(self.given[k].compress(part)) / max(1, len(self.plain.compress(part))), lo, hi

    def found(self, block: str) -> list[tuple]:
        """(from, to, license, reduction, wording, kept, missing, added, changed, exact) of all licenses of a block, the best first."""
        at = [(m.group().lower(), m.span()) for m in _WORD.finditer(block)]
        words, spans, have = [w for w, _ in at], [p for _, p in at], {w for w, _ in at}
        ranked = []
        for whole, k in self.reductions(block):
            for w, wording in enumerate(self.words[k]):
                if not self.own[k][w] <= have:
                    continue
                reduction, lo, hi, a, b = whole, 0, len(words), 0, len(block)
                if whole < MIN_REDUCTION:
                    reduction, lo, hi = self.covered(block, k, wording, spans, words)
                    if reduction < MIN_REDUCTION and words[lo:hi] != wording:  # a few words are too short to be measured
                        continue
                    a, b = spans[lo][0], spans[hi - 1][1]
                    b += block[b : b + 1] == "."
                missing = added = changed = kept = 0
                used = set()
                for op, i, j, c, d in SequenceMatcher(None, wording, words[lo:hi], autojunk=False).get_opcodes():
                    if op == "equal":
                        kept += j - i
                        used.update(range(lo + c, lo + d))
                    elif op == "delete":
                        missing += j - i
                    elif op == "insert":
                        added += (d - c) if 0 < i < len(wording) else 0  # words around the wording are no difference
                    else:
                        changed += max(j - i, d - c) if 0 < i and j < len(wording) else j - i
                if kept >= MIN_KEPT * len(wording):
                    row = (a, b, self.names[k], round(reduction, 6), w, round(kept / len(wording), 6), missing, added, changed, missing + added + changed == 0)
                    ranked.append(((kept / len(wording), -added - changed, reduction), row, used, self.own[k][w]))
        alone = lambda row: self.words[self.names.index(row[2])][row[4]][0] != "or"  # noqa: E731  (others stand beside a license only)
        ranked.sort(key=lambda r: (alone(r[1]), *r[0]), reverse=True)
        out, taken, names = [], set(), set()
        for _, row, used, own in ranked:
            mine = {p for p in used if words[p] in own}
            if out and (row[2] in names or not own <= {words[p] for p in mine} or mine & taken):
                continue
            if not out and not alone(row):
                break
            out.append(row)
            names.add(row[2])
            taken |= used
        return out


def notices(ranker: Ranker, text: str) -> list[tuple]:
    """What ``Ranker.found`` has of the blocks of a text; two sentences are one block where only both are an exact wording."""
    out, done = [], 0
    for a, b, c in blocks(text):
        if a < done:
            continue
        got = ranker.found(text[a:b])
        if c > b and not any(r[-1] for r in got):
            both = ranker.found(text[a:c])
            if any(r[-1] and a + r[1] > b and a + r[0] < b for r in both) and not any(r[-1] for r in ranker.found(text[b:c].lstrip())):
                got, done = both, c
        out += [(a + r[0], a + r[1], *r[2:]) for r in got]
    return out


def licenses_of(ranker: Ranker, bodies: Bodies, text: str) -> list[tuple]:
    """Rows of the bodies of a text and of the notices that aren't part of one, in order."""
    whole = bodies.found(text)
    starts = [r[0] for r in whole]

    def part_of_one(r: tuple) -> bool:
        k = bisect_left(starts, r[1])
        for body in whole[max(0, k - 1) : k + 1]:
            near = r[0] < body[1] + BESIDE and body[0] - BESIDE < r[1]
            if near and (r[2] in (body[2], "Proprietary") or (r[0] < body[1] and body[0] < r[1])):
                return True
        return False

    return sorted(whole + [r for r in notices(ranker, text) if not (whole and part_of_one(r))])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each license of a block (schema ``OUT``).

    Positions count characters. Null and empty texts have no blocks; texts may be of any length; a null id
    stays null (ids are whole numbers); repeated rows give repeated results. Other columns are ignored; an
    empty table gives no rows. Of equal templates the one listed first wins.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker, bodies = Ranker(), Bodies()
        names = [x.split()[0] for x in OUT.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), []
            hit = pc.fill_null(pc.match_substring_regex(texts, CUES), False)
            for k in pc.indices_nonzero(hit).to_pylist():
                text = texts[k].as_py()
                rows += [(ids[k].as_py(), *r) for r in licenses_of(ranker, bodies, text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, OUT)
