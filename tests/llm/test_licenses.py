from __future__ import annotations

import itertools
import random
import re
import textwrap
import time

import pytest

from quillon.llm import licenses

from .conftest import ODD

MIT = """The MIT License (MIT)

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ENDORSE = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
DISCLAIM = 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING'
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""


def wrapped(text, width=60):
    return "\n".join(x for line in text.split("\n") for x in textwrap.wrap(line, width))


def commented(text, sign):
    return "\n".join(f"{sign} {line}" for line in text.split("\n"))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Some prose.\nReleased under the MIT License.\nMore.", ["MIT"]),
        ("Text. LICENSED under the   Apache License, version 2.0. Text", ["Apache-2.0"]),
        ("Released under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("This is licensed under the MIT License - see the LICENSE file", ["MIT"]),
        ("a | b\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", ["GPL-3.0-only", "CC-BY-NC-4.0"]),
        ("Licensed under the GNU GPL v2 or later.", ["GPL-2.0-or-later"]),
        ("Licensed under CC BY-NC-ND 4.0. Also https://creativecommons.org/licenses/by-sa/3.0/", ["CC-BY-NC-ND-4.0", "CC-BY-SA-3.0"]),
        (MIT, ["MIT"]), (wrapped(MIT), ["MIT"]), (wrapped("Before this.\n" + MIT + " And after."), ["MIT"]), (commented(wrapped(MIT), " *"), ["MIT"]),
        (BSD + ENDORSE.format("the copyright holder") + DISCLAIM.format("THE COPYRIGHT HOLDERS"), ["BSD-3-Clause"]),
        (BSD + ENDORSE.format("Google Inc."), ["BSD-3-Clause"]), (wrapped(BSD + ENDORSE.format("the University of Somewhere, Its Board")), ["BSD-3-Clause"]),
        (BSD + DISCLAIM.format("A. PERSON AND OTHERS"), ["BSD-2-Clause"]), (BSD, ["BSD-2-Clause"]),
        (BSD.replace("Redistributions in binary form must", "Copies in binary form shall"), ["LicenseRef-BSD"]),
        (APACHE, ["Apache-2.0"]), (commented(APACHE, "#"), ["Apache-2.0"]), (commented(APACHE, "//"), ["Apache-2.0"]), (APACHE.replace("Licensed under the Apache License, Version 2.0", "Odd notice"), ["Apache-2.0"]),
        (LGPL, ["LGPL-2.1-or-later"]), (ZLIB, ["Zlib"]), ("GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007", ["GPL-3.0-only"]),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", ["EPL-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
        (MIT + "\n\n" + APACHE, ["MIT", "Apache-2.0"]),
        ("// SPDX-License-Identifier: Apache-2.0 OR MIT\n", ["Apache-2.0 OR MIT"]),
        ("The license of this is unknown. Permission is asked. Provided that it is distributed, a driver needs a license.", []), ("", []),
    ],
)
def test_findings(text, found):
    out = licenses.standard().findings(text)
    assert [f[0] for f in out] == found
    assert all(0 <= a < b <= len(text) for _, a, b in out)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM", ["EPL-2.0"]), ("# The MIT License\n\nCopyright (c) 2020 A. Person", ["MIT"]), ("Apache License 2.0", ["Apache-2.0"]),
        ("MIT License\n\nCopyright (c) 2020\n\n" + MIT.split("\n\n", 2)[2], ["MIT"]), ("BSD 3-Clause License\n\n" + BSD + ENDORSE.format("X"), ["BSD-3-Clause"]),
        ("License: MIT", ["MIT"]), ('{"license": "MIT", "x": 1}', ["MIT"]), ("license = 'GPL-3.0-or-later'", ["GPL-3.0-or-later"]), ('license = "Apache-2.0 OR MIT"', ["Apache-2.0", "MIT"]),
        ("Dual-licensed under MIT or Apache-2.0.", ["MIT", "Apache-2.0"]), ("licensed under the MIT License and the Apache License 2.0", ["MIT", "Apache-2.0"]), ("Released under MIT.", ["MIT"]),
        ("Licensed under either of\n * Apache License, Version 2.0 ([LICENSE-APACHE](x) or http://www.apache.org/licenses/LICENSE-2.0)\n * MIT license (http://opensource.org/licenses/MIT)\nat your option.", ["Apache-2.0", "MIT"]),
        ("GNU Library General Public License, version 2", ["LGPL-2.0-only"]), ("Released under the Python Software Foundation License", ["PSF-2.0"]), ("Microsoft Public License (Ms-PL)", ["MS-PL"]),
        ("This file is not licensed under the MIT License", []), ("This is no longer licensed under the MIT License or the ISC License.", []), ("It isn't licensed under the MIT License, but released under the ISC license.", ["ISC"]),
        ("It is not only licensed under the MIT License", ["MIT"]), ("If you do not agree, stop. Licensed under the MIT License.", ["MIT"]),
        ("provided by MIT Press", []), ("distributed under MIT supervision", []), ("Lizenz: mit der Hand. License: mit der Hand", []), ("Everybody knows the MIT License by now.", []),
    ],
)
def test_titles_fields_pairs_and_denials(text, found):
    assert [f[0] for f in licenses.standard().findings(text)] == found
    assert not found or re.search(f"(?i){licenses.ANCHORS}", text)


@pytest.mark.parametrize(
    ("text", "times", "findings"),
    [
        ("This is released under the MIT License.\n", 20_000, 20_000),
        ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\n", 10_000, 20_000),
        (MIT + "\n" + BSD, 2_000, 4_000),  # each of whose chains could go on in the next copy
    ],
)
def test_many_notices_in_one_text(text, times, findings):
    began = time.perf_counter()
    out = licenses.standard().findings(text * times)
    assert len(out) == findings
    assert time.perf_counter() - began < 20


def test_chains_of_long_sequences_are_those_of_their_parts():
    """Parts that no chain can bridge give their own chains, however many there are."""
    draw = random.Random(11)
    rules = tuple((f"L{n}", tuple(draw.sample("abcdef", draw.randrange(2, 5))), ()) for n in range(5))
    matcher = licenses.Rules({}, rules)
    parts = [[draw.choice("abcdefz") for _ in range(draw.randrange(1, 8))] for _ in range(300)]
    whole, want = [], []
    for part in parts:
        want += [(name, [len(whole) + p for p in places]) for name, places in by_brute_force(rules, part)]
        whole += part + ["z"] * (licenses.GAP + 1)
    assert sorted(matcher.chains(whole), key=lambda f: f[1]) == sorted(want, key=lambda f: f[1])


def test_every_name_has_an_anchor():
    rules = licenses.standard()
    for name, patterns in licenses._names().items():
        for words in patterns:
            text = " ".join(w.split("|")[0] for w in words.split() if not w.endswith("?"))
            assert re.search(f"(?i){licenses.ANCHORS}", text), (name, text)
            assert rules.sentences(text), (name, text)


def by_brute_force(rules, ids):
    """The greatest chains, by trying every subsequence: most identifiers, then the first place, then the earlier rule."""
    used, out = set(), []
    while True:
        best = None
        for number, (license_id, sequence, needs) in enumerate(rules):
            longest = {}
            for size in range(1, len(ids) + 1):
                for places in itertools.combinations([p for p in range(len(ids)) if p not in used and ids[p] in sequence], size):
                    order = [sequence.index(ids[p]) for p in places]
                    if all(a < b for a, b in zip(order, order[1:])) and all(b - a <= licenses.GAP + 1 for a, b in zip(places, places[1:])):
                        longest.setdefault(places[0], {}).setdefault(size, []).append(places)
            for first, sizes in longest.items():
                chain = min(sizes[max(sizes)])  # of equal ones the one whose places come first
                key = (-len(chain), first, number)
                if set(needs) <= {ids[p] for p in chain} and (best is None or key < best[0]):
                    best = (key, license_id, chain)
        if best is None:
            return out
        used.update(best[2])
        out.append((best[1], list(best[2])))


@pytest.mark.parametrize("seed", range(6))
def test_chains_by_brute_force(seed):
    draw = random.Random(seed)
    names = "abcdef"
    rules = tuple((f"L{n}", tuple(draw.sample(names, draw.randrange(1, 5))), ()) for n in range(4))
    rules += tuple((f"N{n}", sequence, (draw.choice(sequence),)) for n, (_, sequence, _) in enumerate(rules))
    matcher = licenses.Rules({}, rules)
    for _ in range(40):
        ids = [draw.choice(names + "z") for _ in range(draw.randrange(0, 9))]
        assert matcher.chains(ids) == by_brute_force(rules, ids), (rules, ids)


def test_every_sentence_has_an_anchor_and_is_found():
    """The shortest text of each pattern passes the filter, and is read back as its sentence (or a longer one that begins there)."""
    rules = licenses.standard()
    patterns = licenses._notices() | {k: [v] for k, v in licenses.SENTENCES.items()}
    for name, each in patterns.items():
        for words in each:
            text = " ".join("X" if w == "*" else w.split("|")[0] for w in words.split() if not w.endswith("?"))
            assert re.search(f"(?i){licenses.ANCHORS}", text), (name, text)
            assert rules.sentences(text)[0][1] == 0, (name, text)
    assert len(patterns) < 200


def test_scan(spark, odd, none):
    out = licenses.scan(odd)
    assert out.count() == len(ODD) and out.where("n_findings > 0").count() == 0
    assert licenses.scan(none).count() == 0


#: Lines of the given documents that name a license.
LINES = {
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0": "Apache-2.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


def test_scan_against_lines(spark):
    """Every line of the documents that names a license is found, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: sorted({LINES[x.strip()] for x in (r.text or "").split("\n") if x.strip() in LINES}) for r in docs.collect()}
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    assert got == want and sum(map(bool, want.values())) > 5
