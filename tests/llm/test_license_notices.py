"""Notices as files carry them: wrapped, commented, with holders and years, and with the wrong version."""

import textwrap

import pytest

from tidemark.llm.licenses import LEAST_SAVED, SHARED, TEMPLATES, Scanner, tagged, words

GPL = TEMPLATES["GPL-3.0-or-later"][0]
MIT = TEMPLATES["MIT"][1]
BSD = TEMPLATES["BSD-3-Clause"][0]


def licenses(text):
    return sorted({f["license"] for f in Scanner().scan(text.encode())})


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "-- ", "dnl "])
@pytest.mark.parametrize("name, text", [("GPL-3.0-or-later", GPL), ("MIT", MIT), ("CC0-1.0", TEMPLATES["CC0-1.0"][0])])
@pytest.mark.parametrize("width", [40, 70])
def test_wrapped_and_commented(prefix, name, text, width):
    lines = textwrap.wrap(text, width)
    around = ["A file of things.", "", *lines, "", "It goes on with the code."]
    assert name in licenses("\n".join((prefix + x).rstrip() for x in around))


@pytest.mark.parametrize("text, want", [
    ("Licensed under the MIT License.", ["MIT"]),
    ("Distributed under the terms of the MIT License.", ["MIT"]),
    ("Copyright (c) 2020 Acme. All rights reserved.", ["LicenseRef-all-rights-reserved"]),
    ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
    (BSD.replace("the copyright holder", "Acme Inc."), ["BSD-3-Clause"]),
    (GPL.replace("version 3", "version 2"), ["GPL-2.0-or-later"]),
    (GPL.replace("version 3", "version 4"), []),
    ("This work is licensed under the GNU General Public License, version 2 or (at your option) any later version.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", []),
    ("Licensed under CC BY-ND 4.0.", []),
    ("Licensed under the Apache License, Version 1.1.", []),
    ("Not released under the BSD License.", []),
])
def test_names_and_versions_must_agree(text, want):
    assert licenses("Words before.\n" + text + "\nand after") == want


TWO = "\n".join(["Copyright (c) 2019, Jo Doe", "All rights reserved.", "", SHARED["BSD"][0] + ":", "", *(f"{k}. {textwrap.fill(c, 70)}" for k, c in enumerate(SHARED["BSD"][1:], 1)), "", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"])


def test_shared_clauses():
    """A shared clause names the family; all of them the license that has no others; one more clause the license that has it."""
    assert [x for x in licenses(TWO) if "reserved" not in x] == ["BSD-2-Clause"]
    assert [x for x in licenses(TWO + "\n\n3. " + textwrap.fill(BSD, 70)) if "reserved" not in x] == ["BSD-3-Clause"]
    assert licenses(SHARED["BSD"][0]) == ["BSD"] and licenses(SHARED["BSD"][2]) == ["BSD"]
    far = SHARED["BSD"][0] + "\n" + "word " * 1000 + "\n" + SHARED["BSD"][1] + "\n" + SHARED["BSD"][2]
    assert licenses(far) == ["BSD"]


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_statement_of_the_catalogue(name):
    """Each statement alone, and the identifier line, name their license and no other."""
    for text in tagged({name: TEMPLATES[name]})[name]:
        assert licenses("Some words.\n\n" + text + "\n\nOther words.") == [name], text


def test_ordinary_headers():
    lgpl = textwrap.fill(TEMPLATES["LGPL-2.1-or-later"][0], 72)
    assert licenses("# Copyright (C) 2001 Some One\n#\n" + "\n".join("# " + x for x in lgpl.splitlines())) == ["LGPL-2.1-or-later"]
    assert licenses("// SPDX-License-Identifier: MIT\nint main() {}") == ["MIT"] and licenses("This project is MIT licensed.") == ["MIT"]
    assert licenses("/* SPDX-License-Identifier: GPL-2.0-only */") == ["GPL-2.0-only"] and len(TEMPLATES) >= 30
    assert licenses("SPDX-License-Identifier: Foo-1.0") == []


def test_ranking_and_differences_of_a_plain_loop():
    """Shares saved from plain compressions, one after the other, and differences from aligned word lists."""
    import zstandard

    scanner = Scanner()
    parameters = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, min_match=3, window_log=17)
    for block in (GPL, MIT[:150], "Released under the MIT License by us.", "no license here"):
        raw = block.encode()
        alone = len(zstandard.ZstdCompressor(compression_params=parameters).compress(raw))
        want = []
        for i, (_, text, _, _) in enumerate(scanner.templates):
            with_it = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
            share = (alone - len(with_it.compress(raw))) / max(8, min(alone, len(text)))
            if share >= LEAST_SAVED:
                want.append((share, i))
        assert scanner.ranked(raw) == sorted(want, key=lambda x: (-x[0], x[1]))
    at = next(i for i, t in enumerate(scanner.templates) if t[1] == MIT)
    changed = MIT.replace("any person", "every person").replace("publish, ", "")
    assert scanner.differences(at, words(changed)) == (3, ["-any", "+every", "-publish"])
