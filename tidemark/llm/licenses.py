"""License scans by conditional compression.

Candidate blocks are the lines of a text that mention licensing, with their neighbours up to a blank line
or the length of the longest template; long lines are cut into windows. Each block, without comment marks, is
compressed alone and with each license template as a zstandard raw dictionary; templates are ranked by the
share of bytes saved. All that save enough are confirmed by the exact word differences between the template
and the block: versions and names must agree, holders and years are free.

Templates are headers, statements and clauses. A clause that several licenses share names their family only; where
all clauses of the family stand together they are the license that has just these, and where a clause that only one license
has stands with them, they are part of that license.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values

#: License statements as commonly written, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "This project is MIT licensed.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0-only": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1-only": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation.",
    ],
    "LGPL-2.1-or-later": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0-only": ["Licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0."],
    "AFL-3.0": ["Licensed under the Academic Free License version 3.0."],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "MS-PL": ["Licensed under the Microsoft Public License."],
    "NCSA": ["Licensed under the University of Illinois/NCSA Open Source License."],
    "PostgreSQL": ["Licensed under the PostgreSQL License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "LicenseRef-all-rights-reserved": ["Copyright. All rights reserved."],
}
#: Clauses that several licenses share, by family.
SHARED = {
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
}
#: The license that has all clauses of a family and no others, and the ones that have more.
COMPLETE = {"BSD": ("BSD-2-Clause", {"BSD-3-Clause"})}


def tagged(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """templates with the line that names each license by its identifier."""
    return {name: [*texts, *([] if name.startswith("LicenseRef") else [f"SPDX-License-Identifier: {name}"])] for name, texts in templates.items()}


_MENTION = re.compile(rb"licen[cs]|copyright|unencumbered|anyone is free|\xc2\xa9|permission|redistribut|rights reserved|creative commons|public domain", re.I)
_WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]")
_MARK = rb"[ \t]*(?:(?:/\*+|\*+/?|//+|#+|--+|;+|%+|>+|<!--|\.\.|(?:dnl|rem)\b)[ \t]*)*"
_MARKS = re.compile(rb"^" + _MARK, re.I | re.M)
_BLANK = re.compile(rb"\n" + _MARK + rb"\r?(?=\n)", re.I)
#: A block reaches so many bytes from a mention at least, and closes beyond BLOCK_BYTES; mentions closer than GAP bytes share one.
BLOCK_BYTES, REACH, GAP = 1536, 480, 160
#: Templates that save less of the block's or their own bytes than this are not compared in words.
LEAST_SAVED = 0.25
#: Share of a template's words that may differ, one word at least; words of _NAMES and versions never may.
DIFFERENT = 0.1
_NAMES = set("mit apache gnu gpl lgpl agpl lesser library affero creative commons cc by nc sa nd attribution sharealike noncommercial noderivatives zero cc0 bsd mozilla eclipse copyright rights reserved later not".split())
_NAMES |= {f"by-{x}" for x in ("nc", "sa", "nd", "nc-sa", "nc-nd")} | {f"attribution-{x}" for x in ("noncommercial", "sharealike", "noderivatives", "noncommercial-sharealike", "noncommercial-noderivatives", "noncommercial-noderivs", "noderivs")}
_NAMES |= {"2-clause", "3-clause", "mpl", "epl", "eupl", "isc", "sil", "font", "boost", "artistic", "academic", "microsoft", "ncsa", "postgresql", "cddl", "unencumbered", "only", "program", "library", *(name.lower() for name in TEMPLATES)}
_YEAR = re.compile(r"(?:19|20)\d\d(?:-(?:19|20)?\d\d)?")
_VERSION = re.compile(r"\d+(?:\.\d+)*\+?")
#: Words that may come in anywhere, words that a holder's name may replace, and the most words of such a name.
_FREE = {"the", "terms", "of", "c"}
_HOLDER = {"the", "copyright", "holder", "author"}
HOLDER_WORDS = 12


def words(text: str) -> list[str]:
    """Lower-case words; versions without a leading v and trailing zeros."""
    return [re.sub(r"(?:\.0)+$", "", w.removeprefix("v")) if re.fullmatch(r"v?\d+(?:\.\d+)*", w) else w for w in _WORD.findall(text.lower())]


def fixed(word: str) -> bool:
    """Whether a word tells licenses apart."""
    return word in _NAMES or bool(_VERSION.fullmatch(word) and not _YEAR.fullmatch(word))


def candidate_blocks(data: bytes, reach: int = REACH) -> list[tuple[int, int]]:
    """Byte spans around mentions, up to a blank line or the last line end within reach; a span that grows beyond the size of a block is closed and the next one overlaps it."""
    spans: list[list[int]] = []
    most = max(BLOCK_BYTES, 3 * reach)
    for m in _MENTION.finditer(data):
        low, high = max(0, m.start() - reach), min(len(data), m.end() + reach)
        lo, hi = low, high
        if low:
            line = data.find(b"\n", low - 1, m.start())
            lo = line + 1 if line >= 0 else low
        for blank in _BLANK.finditer(data, max(0, lo - 1), m.start() + 1):
            lo = blank.end() + 1
        if high < len(data):
            line = data.rfind(b"\n", m.end(), high)
            hi = line if line >= 0 else high
        blank = _BLANK.search(data, m.end(), min(len(data), hi + 1))
        hi = blank.start() if blank else hi
        if spans and lo - spans[-1][1] < GAP and hi - spans[-1][0] <= most:
            spans[-1][1] = max(spans[-1][1], hi)
        elif not spans or hi > spans[-1][1]:
            spans.append([lo, hi])
    return [(a, b) for a, b in spans]


class Scanner:
    """templates: statements by license; shared: clauses by family; complete: see COMPLETE. Without templates those of this module."""

    def __init__(self, templates: dict[str, list[str]] | None = None, shared: dict[str, list[str]] | None = None, complete: dict[str, tuple[str, set[str]]] | None = None):
        if templates is None:
            templates, shared, complete = tagged(TEMPLATES), SHARED, COMPLETE
        self.complete = complete or {}
        self.clauses = {family: {f"{family}/{k}": text for k, text in enumerate(texts)} for family, texts in (shared or {}).items()}
        every = [*((name, t) for name, texts in templates.items() for t in texts), *(pair for of in self.clauses.values() for pair in of.items())]
        parameters = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, min_match=3, window_log=17)
        self.plain = zstandard.ZstdCompressor(compression_params=parameters)
        self.templates = [(name, text, words(text), zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)) for name, text in every]
        self.reach = max([REACH, *(len(t[1].encode()) * 3 // 2 for t in self.templates)])

    def blocks(self, data: bytes) -> list[tuple[int, int]]:
        return candidate_blocks(data, self.reach)

    def ranked(self, block: bytes) -> list[tuple[float, int]]:
        """(share of the smaller of block and template that is saved, template), best first."""
        alone = len(self.plain.compress(block))
        saved = [(alone - len(t[3].compress(block))) / max(8, min(alone, len(t[1]))) for t in self.templates]
        return sorted(((s, i) for i, s in enumerate(saved) if s >= LEAST_SAVED), key=lambda x: (-x[0], x[1]))

    def differences(self, template: int, block_words: list[str]) -> tuple[int, list[str]] | None:
        """Words of the template that the block lacks or has other words for, and words put among them; None if those tell the licenses apart."""
        want = self.templates[template][2]
        core = SequenceMatcher(None, want, block_words, autojunk=False).find_longest_match()
        if not core.size:
            return None
        # the stretch of the block that can hold the template
        first = max(0, core.b - core.a - HOLDER_WORDS)
        got = block_words[first : core.b + len(want) - core.a + HOLDER_WORDS]
        ops = SequenceMatcher(None, want, got, autojunk=False).get_opcodes()
        same = [k for k, o in enumerate(ops) if o[0] == "equal"]
        diffs = []
        for k, (kind, a, b, c, d) in enumerate(ops):
            if kind == "equal":
                continue
            inside = same[0] <= k <= same[-1]
            lost, new = want[a:b], got[c:d] if inside else []
            named = inside and len(new) <= HOLDER_WORDS and (set(lost) <= _HOLDER if lost else a > 0 and want[a - 1] == "copyright")
            if named and "not" not in new:
                continue
            if any(map(fixed, lost + new)):
                return None
            diffs += [f"-{w}" for w in lost] + [f"+{w}" for w in new if w not in _FREE and not _YEAR.fullmatch(w)]
        after = got[ops[same[-1]][4] :][:8]
        if "later" not in want and "or" in after[:2] and "later" in after:
            return None
        return len(diffs), diffs

    def scan(self, data: bytes) -> list[dict]:
        """Findings of a whole text: license, byte span, share saved, differing words; of a span and license the best."""
        best: dict[tuple, dict] = {}
        for lo, hi in self.blocks(data):
            block = data[lo:hi]
            if block.count(b"\n"):  # each line is also a block of its own
                at, pieces = lo, [(lo, hi)]
                for line in block.split(b"\n"):
                    if _MENTION.search(line):
                        pieces.append((at, at + len(line)))
                    at += len(line) + 1
            else:
                pieces = [(lo, hi)]
            for a, b in pieces:
                raw = b" ".join(_MARKS.sub(b"", data[a:b]).split())
                got = words(raw.decode("utf-8", "replace"))
                for share, i in self.ranked(raw):
                    compared = self.differences(i, got)
                    if compared and compared[0] <= max(1, DIFFERENT * len(self.templates[i][2])):
                        n, diffs = compared
                        found = {"license": self.templates[i][0], "start": a, "end": b, "saved": round(share, 4), "differing": n, "words": diffs}
                        key = (found["license"], lo)
                        if key not in best or (n, b - a) < (best[key]["differing"], best[key]["end"] - best[key]["start"]):
                            best[key] = found
        return self.gathered(sorted(best.values(), key=lambda f: (f["start"], f["license"])))

    def gathered(self, found: list[dict]) -> list[dict]:
        """Findings with shared clauses made licenses where they are complete, else their family; clauses of one notice are
        no farther apart than a block's size."""
        for family, clauses in self.clauses.items():
            whole, wider = self.complete.get(family, (family, set()))
            mine = [f for f in found if f["license"] in clauses]
            others = [f for f in found if f["license"] in wider]
            groups: list[list[dict]] = []
            for f in mine:
                if groups and f["start"] - max(g["end"] for g in groups[-1]) <= BLOCK_BYTES:
                    groups[-1].append(f)
                else:
                    groups.append([f])
            for group in groups:
                lo, hi = min(f["start"] for f in group) - BLOCK_BYTES, max(f["end"] for f in group) + BLOCK_BYTES
                found = [f for f in found if f not in group]
                if not any(lo <= o["end"] and o["start"] <= hi for o in others):
                    name = whole if {f["license"] for f in group} == set(clauses) else family
                    words = [w for f in group for w in f["words"]]
                    found.append({"license": name, "start": min(f["start"] for f in group), "end": max(f["end"] for f in group), "saved": max(f["saved"] for f in group), "differing": sum(f["differing"] for f in group), "words": words})
        return sorted(found, key=lambda f: (f["start"], f["license"]))


_FOUND = "array<struct<license:string,start:bigint,end:bigint,saved:double,differing:bigint,words:array<string>>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_blocks, licenses (sorted, distinct), findings.

    Whole texts are scanned. A null or empty text has no block and an empty list; repeated rows are
    scanned one by one; other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("differing", pa.int64()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            blocks, found = [], []
            for data in byte_values(batch.column(1)):
                blocks.append(len(scanner.blocks(data)))
                found.append(scanner.scan(data) if blocks[-1] else [])
            names = [sorted({f["license"] for f in x}) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(found, kind)], [id_col, "n_blocks", "licenses", "findings"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_blocks long, licenses array<string>, findings {_FOUND}")
