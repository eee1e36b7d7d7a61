"""License scans by sentence rules.

Known license sentences have identifiers, and patterns of words: `a|b` is either word, `a?` a word that may be left out, and
`*` a slot of up to SLOT words, for names of holders. A text is normalised to its words, lower-cased, so that line ends,
comment signs and marks do not matter. Every known sentence in it becomes its identifier with its place; of sentences
that begin at one word the longest counts, and the search goes on behind it. A name of a license is a notice where a verb says
so ("released under", but not after a negation), where it is a line of its own, where it is the value of a field ("License: MIT"), and
where it follows such a name by "or" or "and". Rules are then matched with the sequence
of identifiers. A rule is a license and an ordered sequence: a chain of identifiers in that order, with at most GAP others
between two of them, is a finding, provided that the identifiers which the rule needs are in it. The longest chains are
taken first, of equal ones the one that begins first, then the earlier rule; each identifier serves one finding.

The catalogue covers notices, titles, addresses and texts of the licenses in NAMES and of the Creative Commons family, and
the sentences of the MIT, ISC, BSD, Apache, GPL, LGPL, AGPL, MPL, zlib and Boost texts and of the Unlicense. Others are not known.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_batches, text_of

#: Words that a slot may hold, and identifiers that may lie between two of a chain.
SLOT, GAP = 12, 3
#: Names of licenses as notices spell them.
NAMES = {
    "Apache-2.0": ("apache software? license version? v? 2|v2 0", "apache version? v? 2|v2 0 license?", "apache license v2 0"),
    "MIT": ("mit license", "expat license", "mit x11 license"),
    "BSD-2-Clause": ("bsd 2 clause license?", "2 clause bsd license?", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license?", "3 clause bsd license?", "new|modified|revised bsd license"),
    "0BSD": ("zero clause bsd license?", "0bsd license?"),
    "ISC": ("isc license",),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version? 1 0",),
    "MPL-2.0": ("mozilla public license version? v? 2|v2 0", "mpl version? v? 2|v2 0"),
    "EPL-1.0": ("eclipse public license version? v? 1|v1 0",),
    "EPL-2.0": ("eclipse public license version? v? 2|v2 0", "epl version? v? 2|v2 0"),
    "GPL-2.0": ("gnu? general public license gpl? version? v? 2|v2 0?", "gnu? gpl version? v? 2|v2 0?", "gnu? gplv2"),
    "GPL-3.0": ("gnu? general public license gpl? version? v? 3|v3 0?", "gnu? gpl version? v? 3|v3 0?", "gnu? gplv3"),
    "LGPL-2.0": ("gnu? library general public license lgpl? version? v? 2|v2 0?",),
    "LGPL-2.1": ("gnu? lesser general public license lgpl? version? v? 2|v2 1", "gnu? lgpl version? v? 2|v2 1", "gnu? lgplv2 1"),
    "LGPL-3.0": ("gnu? lesser general public license lgpl? version? v? 3|v3 0?", "gnu? lgpl version? v? 3|v3 0?", "gnu? lgplv3"),
    "AGPL-3.0": ("gnu? affero general public license agpl? version? v? 3|v3 0?", "gnu? agpl version? v? 3|v3 0?", "gnu? agplv3"),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1? 0?", "creative commons zero v? 1? 0? universal? license?", "creative commons cc0 1? 0? universal? license?"),
    "Artistic-2.0": ("artistic license version? v? 2|v2 0",),
    "WTFPL": ("wtfpl",),
    "PSF-2.0": ("psf license agreement? version? v? 2|v2? 0?", "python software foundation license agreement? version? v? 2|v2? 0?"),
    "MS-PL": ("microsoft public license ms? pl?", "ms pl license?"),
}
#: Licenses whose name is completed by `-only`, or by `-or-later` where later versions are allowed.
VERSIONED = ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
#: Terms and versions of the Creative Commons licenses.
CC_TERMS = {"BY": "attribution", "SA": "sharealike", "NC": "noncommercial", "ND": "noderivatives|noderivs"}
CC_CODES, CC_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("1.0", "2.0", "2.5", "3.0", "4.0")
VERBS = "licensed|released|distributed|available|provided|published|offered|covered|shared"
NOTICE = VERBS + " under|by the? terms? and? conditions? of? the? "
#: A notice up to the name; a field; what joins one name to the next.
LEAD, FIELD, JOIN = VERBS + " under|by the? terms? and? conditions? of? either? of? a? the? ", "license|licence ", "or|and under? the? terms? of? the? "
LATER = " or at? your? option? any? later version?"
_AS_GNU = "this|the * is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version} of the license or at your option any later version"
_AS_GNU_ONLY = "this|the * is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license version {version}? as published by the free software foundation version? {version}? of? the? license?"
#: Sentences of license texts.
SENTENCES = {
    "apache2-comply": "you may not use this file|software|work|project except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http|https www? apache org licenses license 2 0",
    "apache2-url": "http|https www? apache org licenses license 2 0",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-limits": "see the license for the specific language governing permissions and limitations under the license",
    "apache2-title": "apache license version 2 0 january 2004",
    "mit-title": "the mit license mit",
    "mit-url": "opensource org licenses|license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and the author|authors disclaims|disclaim all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of? the? * nor the names? of? its? * may be used to endorse or promote products derived from this software without specific? prior written permission",
    "bsd-endorse-names": "the name|names of the? * may not be used to endorse or promote products derived from this software without specific? prior written permission",
    "bsd-advertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement|acknowledgment",
    "bsd-disclaimer": "this software is provided by * as is and|without any|warranty express? or? implied? warranties?",
    "gpl2-later": _AS_GNU.format(kind="", version="2"),
    "gpl3-later": _AS_GNU.format(kind="", version="3"),
    "lgpl20-later": _AS_GNU.format(kind="library ", version="2"),
    "lgpl21-later": _AS_GNU.format(kind="lesser ", version="2 1"),
    "lgpl3-later": _AS_GNU.format(kind="lesser ", version="3"),
    "agpl3-later": _AS_GNU.format(kind="affero ", version="3"),
    "gpl2-only": _AS_GNU_ONLY.format(kind="", version="2"),
    "gpl3-only": _AS_GNU_ONLY.format(kind="", version="3"),
    "gpl-hope": "this|the * is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-received": "you should have received a copy of the gnu lesser|library|affero? general public license along with this *",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "lgpl20-title": "gnu library general public license version 2 june 1991",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v|version 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http|https www? mozilla org mpl 2 0",
    "epl2-text": "this program and the accompanying materials are made available under the terms of the eclipse public license version? v? 2|v2 0",
    "epl1-text": "this program and the accompanying materials are made available under the terms of the eclipse public license version? v? 1|v1 0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "wtfpl-title": "do what the fuck you want to public license",
}
#: Ordered rules: a license, identifiers in their order, and those that must be among them.
RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("MIT", ("mit-title", "notice:MIT", "mit-url", "mit-grant", "mit-condition", "mit-warranty"), ()),
    ("ISC", ("notice:ISC", "isc-grant", "isc-warranty"), ()),
    ("0BSD", ("notice:0BSD", "0bsd-grant", "isc-warranty"), ("0bsd-grant",)),
    ("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse", "bsd-disclaimer"), ("bsd-advertise",)),
    ("BSD-3-Clause", ("notice:BSD-3-Clause", "bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer"), ("bsd-endorse",)),
    ("BSD-3-Clause", ("notice:BSD-3-Clause", "bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse-names", "bsd-disclaimer"), ("bsd-endorse-names",)),
    ("BSD-3-Clause", ("notice:BSD-3-Clause", "bsd-redistribute", "bsd-source", "bsd-binary", "bsd-disclaimer"), ("notice:BSD-3-Clause",)),
    ("BSD-2-Clause", ("notice:BSD-2-Clause", "bsd-redistribute", "bsd-source", "bsd-binary", "bsd-disclaimer"), ("bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("notice:BSD-2-Clause", "bsd-redistribute", "bsd-source", "bsd-binary", "bsd-disclaimer"), ("notice:BSD-2-Clause",)),
    ("LicenseRef-BSD", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-endorse-names", "bsd-disclaimer"), ()),
    ("Apache-2.0", ("apache2-title", "notice:Apache-2.0", "apache2-comply", "apache2-copy", "apache2-url", "apache2-as-is", "apache2-limits"), ()),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-hope", "gpl-received"), ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-received"), ("gpl2-later",)),
    ("LGPL-2.0-or-later", ("lgpl20-later", "gpl-hope", "gpl-received"), ("lgpl20-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later", "gpl-hope", "gpl-received"), ("lgpl21-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-hope", "gpl-received"), ("lgpl3-later",)),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-hope", "gpl-received"), ("agpl3-later",)),
    ("GPL-3.0-only", ("gpl3-only", "gpl-hope", "gpl-received"), ("gpl3-only",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-received"), ("gpl2-only",)),
    ("GPL-2.0-only", ("gpl2-title",), ()),
    ("GPL-3.0-only", ("gpl3-title",), ()),
    ("LGPL-2.0-only", ("lgpl20-title",), ()),
    ("LGPL-2.1-only", ("lgpl21-title",), ()),
    ("LGPL-3.0-only", ("lgpl3-title",), ()),
    ("AGPL-3.0-only", ("agpl3-title",), ()),
    ("LicenseRef-GPL", ("gpl-hope", "gpl-received"), ()),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy"), ()),
    ("EPL-2.0", ("epl2-text",), ()),
    ("EPL-1.0", ("epl1-text",), ()),
    ("Zlib", ("notice:Zlib", "zlib-as-is", "zlib-grant"), ("zlib-grant",)),
    ("BSL-1.0", ("notice:BSL-1.0", "boost-grant"), ()),
    ("Unlicense", ("unlicense-domain",), ()),
    ("WTFPL", ("wtfpl-title",), ()),
)
#: A tag that names licenses itself.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]*[A-Za-z0-9.+)])")
#: Each known sentence and tag has one of these.
ANCHORS = "licen|permission|permitted|redistribut|warrant|endorse|copyright|mozilla|public domain|acknowledg|this software|wtfpl|cc0|cc.by|creative *commons|general public|gpl|apache|bsd|\\b(?:mpl|epl|psf|ms.pl)\\b|under\\s+(?:\\S+\\s+){0,8}?(?:mit|apache|bsd|isc|zlib|mpl|epl|psf|ms)\\b"

_WORD = re.compile(r"[^\W_]+")


_NEWLINE = re.compile(r"[\n\r\v\f]")
#: What denies the notice that follows: at most two words later, in the same clause.
_DENIED = re.compile(r"(?:\bnot|\bnever|\bno longer|n['’]t)(?:\s+(?!only\b)\w+){0,2}\s+$", re.I)
#: What may follow a name that is a line of its own, and one that is no more than an identifier.
_LINE_ENDS = re.compile(r"[^\w\n\r\v\f(\[]*(?:$|[\n\r\v\f(\[])")
_NAME_ENDS = re.compile(r"\s*(?:$|[^\w\s]|(?:or|and|licen[sc]ed?)\b)|[^\S\n]*\n", re.I)
_FIELD_SIGN = re.compile(r"[\"']?\s*[:=]\s*[\"'(\[{]*")


def _names() -> dict[str, list[str]]:
    """Patterns of names by identifier: from NAMES, with later versions told apart, and of the Creative Commons family."""
    out: dict[str, list[str]] = {}
    for license_id, names in NAMES.items():
        for name in names:
            out.setdefault(f"notice:{license_id}-only" if license_id in VERSIONED else f"notice:{license_id}", []).append(name)
            if license_id in VERSIONED:
                out.setdefault(f"notice:{license_id}-or-later", []).append(name + LATER)
    for code in CC_CODES:
        terms = " ".join(CC_TERMS[t] for t in code.split("-"))
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            out[f"notice:CC-{code}-{version}"] = [f"cc {code.lower().replace('-', ' ')} {number}", f"creative commons {terms} {number} international|unported|generic? license?"]
    return out


def _notices() -> dict[str, list[str]]:
    """Patterns of notices by identifier: names after a verb, and addresses of the Creative Commons family."""
    out = {name: [NOTICE + words for words in patterns] for name, patterns in _names().items()}
    for code in CC_CODES:
        for version in CC_VERSIONS:
            out[f"notice:CC-{code}-{version}"].append(f"creativecommons org licenses {code.lower().replace('-', ' ')} {version.replace('.', ' ')}")
    return out


def _identifiers() -> dict[str, list[str]]:
    """Patterns of identifiers that stand for a name, by identifier of the notice."""
    out: dict[str, list[str]] = {}
    for license_id in NAMES:
        words = license_id.lower().replace("-", " ").replace(".", " ")
        if license_id in VERSIONED:
            out[f"notice:{license_id}-only"] = [words + " only?", words.removesuffix(" 0") + " only?"]
            out[f"notice:{license_id}-or-later"] = [words + " or later"]
        else:
            out[f"notice:{license_id}"] = [words]
    return out


def _begins(words: str) -> list[str]:
    """The words that a text of a pattern may begin with."""
    out: list[str] = []
    for word in words.split():
        out += word.rstrip("?").split("|")
        if not word.endswith("?"):
            break
    return out


def pattern(words: str) -> str:
    """The regular expression of a pattern, over words parted by single blanks, each followed by one."""
    out = []
    for word in words.split():
        if word == "*":
            out.append(rf"(?:\S+ ){{0,{SLOT}}}?")
        else:
            body = "|".join(map(re.escape, word.rstrip("?").split("|")))
            out.append(f"(?:(?:{body}) )" + ("?" if word.endswith("?") else ""))
    return "".join(out)


class Rules:
    """Known sentences, names and rules, ready for matching."""

    def __init__(
        self, sentences: dict[str, list[str]], rules: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...],
        names: dict[str, list[str]] | None = None, identifiers: dict[str, list[str]] | None = None,
    ) -> None:
        self.first = self._by_first_word(sentences)
        self.names, self.identifiers = self._by_first_word(names or {}), self._by_first_word(identifiers or {})
        self.lead, self.field, self.join = (re.compile(pattern(x)) for x in (LEAD, FIELD, JOIN))
        self.verbs, self.fields = (frozenset(x.split()[0].split("|")) for x in (LEAD, FIELD))
        self.rules = [(license_id, {name: i for i, name in enumerate(sequence)}, frozenset(needs)) for license_id, sequence, needs in rules]
        self.serves: dict[str, list[tuple[int, int]]] = {}  # for an identifier the rules that have it, and its place there
        for number, (_, index, _) in enumerate(self.rules):
            for name, i in index.items():
                self.serves.setdefault(name, []).append((number, i))

    @staticmethod
    def _by_first_word(sentences: dict[str, list[str]]) -> dict[str, list[tuple[str, re.Pattern]]]:
        out: dict[str, list[tuple[str, re.Pattern]]] = {}
        for name, patterns in sentences.items():
            for words in patterns:
                compiled = re.compile(pattern(words))
                for word in _begins(words):
                    out.setdefault(word, []).append((name, compiled))
        return out

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        """Identifiers of known sentences, with begin and end, in the order of the text; of overlapping ones the first, then the longest."""
        lowered = text.lower()
        if len(lowered) != len(text):  # places must stay those of the text
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lowered)]
        line = "".join(w[0] + " " for w in words)
        begins, at = [], 0
        for w in words:
            begins.append(at)
            at += len(w[0]) + 1
        place = {b: i for i, b in enumerate(begins)} | {at: len(words)}

        def longest(among: dict[str, list[tuple[str, re.Pattern]]], i: int) -> tuple[int, str] | None:
            """The word after the longest match at word i, and its identifier."""
            if i >= len(words):
                return None
            ends = [(m.end(), name) for name, p in among.get(words[i][0], ()) if (m := p.match(line, begins[i])) and m.end() > begins[i]]
            best = max(ends, key=lambda f: f[0], default=None)
            return best and (place[best[0]], best[1])

        def after(p: re.Pattern, i: int) -> int | None:
            m = p.match(line, begins[i]) if i < len(words) else None
            return m and place[m.end()]

        def name(i: int | None, short: bool) -> tuple[int, str] | None:
            """The name of a license at word i, or an identifier that stands for one, and the word after it."""
            best = longest(self.names, i) if i is not None else None
            if best is None and short and i is not None:
                best = longest(self.identifiers, i)
                if best and not _NAME_ENDS.match(text, words[best[0] - 1][2]):
                    return None
            return best

        def named(i: int) -> tuple[int, str, bool] | None:
            """A name that counts as a notice at word i: the word after it, its identifier, and whether it is denied."""
            word, begin, _ = words[i]
            if word in self.verbs and (j := after(self.lead, i)) and (found := name(j, any(w[0] == "under" for w in words[i:j]))):
                return (*found, bool(_DENIED.search(text, max(0, begin - 60), begin)))
            if word in self.fields and i + 1 < len(words) and _FIELD_SIGN.fullmatch(text, words[i][2], words[i + 1][1]) and (found := name(i + 1, True)):
                return (*found, False)
            if not i or _NEWLINE.search(text, words[i - 1][2], begin):
                j = i + (word == "the")
                if (found := name(j, False)) and _LINE_ENDS.match(text, words[found[0] - 1][2]):
                    return (*found, False)
            return None

        out, i = [], 0
        while i < len(words):
            best, notice = longest(self.first, i), named(i) if self.names else None
            if notice and (not best or notice[0] >= best[0]):
                end, identifier, denied = notice
                begin = i
                while True:
                    if not denied:
                        out.append((identifier, words[begin][1], words[end - 1][2]))
                    following = name(after(self.join, end), True)
                    if not following:
                        break
                    begin, (end, identifier) = end, following
                i = end
            elif best:
                out.append((best[1], words[i][1], words[best[0] - 1][2]))
                i = best[0]
            else:
                i += 1
        return out

    def chains(self, ids: list[str]) -> list[tuple[str, list[int]]]:
        """(license, places) of the rules' chains, each place in one chain.

        The longest chain of a rule from a place depends on the next GAP + 1 places only, so what a finding takes away
        changes chains of earlier places no further than a rule reaches, and only these are worked out again. All chains wait in a heap.
        """
        used = [False] * len(ids)
        index = [dict(self.serves.get(name, ())) for name in ids]
        state: list[dict[int, tuple[int, int]]] = [{} for _ in ids]  # for a place and a rule: length of the chain from there, and the next place
        waiting: list[tuple[int, int, int]] = []

        def chain(p: int, number: int) -> list[int]:
            out = []
            while p >= 0:
                out.append(p)
                p = state[p][number][1]
            return out

        def complete(places: list[int], number: int) -> bool:
            return self.rules[number][2] <= {ids[q] for q in places}

        def work(p: int, number: int) -> None:
            length, follow = 1, -1
            for q in range(p + 1, min(len(ids), p + GAP + 2)):
                if number in state[q] and not used[q] and state[q][number][0] >= length and index[q][number] > index[p][number]:
                    length, follow = state[q][number][0] + 1, q
            state[p][number] = length, follow
            if complete(chain(p, number), number):
                heapq.heappush(waiting, (-length, p, number))

        for p in range(len(ids) - 1, -1, -1):
            for number in index[p]:
                work(p, number)
        out = []
        while waiting:
            length, p, number = heapq.heappop(waiting)
            if used[p] or state[p][number][0] != -length:
                continue
            places = chain(p, number)
            if not complete(places, number):
                continue
            out.append((self.rules[number][0], places))
            for q in places:
                used[q] = True
            again: list[tuple[int, int]] = []  # places before those used, from the last to the first
            known: set[tuple[int, int]] = set()

            def ask(q: int, rule: int) -> None:
                for o in range(max(0, q - GAP - 1), q):
                    if not used[o] and rule in index[o] and index[o][rule] < index[q][rule] and (-o, rule) not in known:  # noqa: B023
                        known.add((-o, rule))  # noqa: B023
                        heapq.heappush(again, (-o, rule))  # noqa: B023

            for q in places:
                for rule in index[q]:
                    ask(q, rule)
            while again:
                o, rule = heapq.heappop(again)
                work(-o, rule)
                ask(-o, rule)
        return out

    def findings(self, text: str) -> list[tuple[str, int, int]]:
        """(license, begin, end) of each finding, in the order of the text."""
        found = self.sentences(text)
        out = [(m.group(1), *m.span()) for m in TAG.finditer(text)]
        out += [(license_id, found[c[0]][1], found[c[-1]][2]) for license_id, c in self.chains([f[0] for f in found])]
        return sorted(out, key=lambda f: (f[1], f[2], f[0]))


@lru_cache(maxsize=1)
def standard() -> Rules:
    notices = _notices()
    alone = tuple((name.removeprefix("notice:"), (name,), ()) for name in notices)
    addresses = {name: [p for p in patterns if not p.startswith(VERBS)] for name, patterns in notices.items()}
    return Rules(addresses | {name: [words] for name, words in SENTENCES.items()}, RULES + alone, _names(), _identifiers())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, licenses (distinct, sorted), n_findings, findings (license, start, end in code points).

    Whole texts are looked at; a text without any anchor is not sent to Python, since no known sentence is without one. A
    null or empty text has no findings. Rows that repeat an id, and null ids, have a row each. An empty table gives no
    rows.
    """
    slim = docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("_text"))
    slim = slim.withColumn("_text", F.when(F.col("_text").rlike(f"(?i){ANCHORS}"), F.col("_text")))
    fields = slim.select(id_col).schema.simpleString()[len("struct<") : -1]
    finding = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = standard()
        for batch in batches:
            found = [rules.findings(t) if t else [] for t in batch.column(1).to_pylist()]
            columns = [
                pa.array([sorted({f[0] for f in x}) for x in found], pa.list_(pa.string())),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([[{"license": a, "start": b, "end": c} for a, b, c in x] for x in found], pa.list_(finding)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "licenses", "n_findings", "findings"])

    kinds = "licenses array<string>, n_findings long, findings array<struct<license: string, start: long, end: long>>"
    return map_batches(slim, run, f"{fields}, {kinds}")
