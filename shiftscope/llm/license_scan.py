"""Operator 9 - licence scans by sentence rules.

Texts are cut into units at line ends and after ``. ! ? ; :`` before white space.  A unit,
or several in a row that begin a known sentence, is normalised (lower case, runs of other
characters than letters, digits and inner dots become one space) and looked up among the
known licence sentences.  The sequence of identifiers found is then matched, in order,
against the licence rules, each a sequence of identifiers; up to ``MAX_GAP`` units of
other text may stand between two of them.  Of overlapping matches the one with more
sentences counts, then the earlier rule.

Defined results: null and empty texts have no licences; repeated rows come out one by
one; an empty table gives an empty result; extra columns are ignored.  Whole texts are
scanned: a text is passed over only if it holds none of the words that every known
sentence has one of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shiftscope.llm.common import only, slices, table

MAX_GAP = 3

#: Known licence sentences (fixed values: public licence texts); {n} stands for a version, {h} for a holder and year.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "Licensed under the MIT License.",
    "mit-short-3": "This project is licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "apache-grant": "Licensed under the Apache License, Version {n} (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-{n}",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-short": "Licensed under the Apache License, Version {n}.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-short": "This work is licensed under the GNU General Public License, version {n}.",
    "gpl-short-2": "Licensed under the GNU General Public License, version {n}.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version.",
    "lgpl-short": "This work is licensed under the GNU Lesser General Public License, version {n}.",
    "agpl-short": "This work is licensed under the GNU Affero General Public License, version {n}.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. {n}.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/{n}/.",
    "cc-by": "Licensed under CC BY {n}.",
    "cc-by-sa": "Licensed under CC BY-SA {n}.",
    "cc-by-nc": "Licensed under CC BY-NC {n}.",
    "cc-by-nd": "Licensed under CC BY-ND {n}.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA {n}.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND {n}.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution {n} International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike {n} International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial {n} International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
#: Licence rules: ordered identifiers. ``{n}`` in a name takes the version that a sentence of the match states.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-2",)),
    ("MIT", ("mit-short-3",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-{n}", ("apache-grant", "apache-comply", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-{n}", ("apache-grant", "apache-comply")),
    ("Apache-{n}", ("apache-short",)),
    ("GPL-{n}-or-later", ("gpl-free", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-{n}-or-later", ("gpl-free",)),
    ("GPL-{n}", ("gpl-short",)),
    ("GPL-{n}", ("gpl-short-2",)),
    ("LGPL-{n}-or-later", ("lgpl-free",)),
    ("LGPL-{n}", ("lgpl-short",)),
    ("AGPL-{n}", ("agpl-short",)),
    ("MPL-{n}", ("mpl-notice", "mpl-copy")),
    ("MPL-{n}", ("mpl-notice",)),
    ("CC-BY-{n}", ("cc-by",)),
    ("CC-BY-SA-{n}", ("cc-by-sa",)),
    ("CC-BY-NC-{n}", ("cc-by-nc",)),
    ("CC-BY-ND-{n}", ("cc-by-nd",)),
    ("CC-BY-NC-SA-{n}", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-{n}", ("cc-by-nc-nd",)),
    ("CC-BY-{n}", ("cc-by-long",)),
    ("CC-BY-SA-{n}", ("cc-by-sa-long",)),
    ("CC-BY-NC-{n}", ("cc-by-nc-long",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("all-rights-reserved", ("reserved",)),
]
#: Every known sentence has one of these; single words, so that white space and line ends do not matter.
TRIGGERS = ("licen", "permission", "software", "redistribut", "copyright", "warrant", "reserved", "mozilla", "liab")

_JUNK = re.compile(r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\.")
_VERSION = re.compile(r"(?<![a-z0-9.])v?[0-9]+(?:\.[0-9]+)*(?![a-z0-9])")
_UNIT = re.compile(r"\n|(?<=[.!?;:])[ \t\r\x0b\x0c]+")


def normalise(text: str) -> str:
    """Words of a sentence; list marks and comment signs at its start go too."""
    return " ".join(_JUNK.sub(" ", text.lower()).split())


@lru_cache(maxsize=1)
def _known() -> tuple[dict[str, str], set[str], list]:
    """(sentence with versions as # -> identifier, proper word prefixes' beginnings, rules longest first)."""
    known = {}
    for name, text in SENTENCES.items():
        known[_VERSION.sub("#", normalise(text.replace("{n}", "0")))] = name
    heads = set()
    for s in known:
        words = s.split()
        heads |= {" ".join(words[:k]) for k in range(1, len(words))}
    return known, heads, sorted(enumerate(RULES), key=lambda r: (-len(r[1][1]), r[0]))


def sentences(text: str) -> list[tuple[int, int, str, str]]:
    """(unit number, units taken, identifier, version) of the known sentences in order; the longest at each place."""
    known, heads, _ = _known()
    units = []
    at = 0
    for m in _UNIT.finditer(text):
        units.append(text[at : m.start()])
        at = m.end()
    units.append(text[at:])
    plain = [normalise(u) for u in units]
    found, i = [], 0
    while i < len(units):
        start = i  # empty units before a sentence go with it
        while start < len(units) and not plain[start]:
            start += 1
        best = None
        joined = ""
        for k in range(start, len(units)):
            joined = f"{joined} {plain[k]}".strip()
            key = _VERSION.sub("#", joined)
            words = key.split(" ")
            if len(words) > 1 and words[0] == "#":  # a list number
                key = " ".join(words[1:])
            if key in known:
                version = _VERSION.search(joined)
                best = (i, k + 1 - i, known[key], version[0].removeprefix("v") if version else "")
            if key not in heads:
                break
        if best:
            found.append(best)
            i += best[1]
        else:
            i = start + 1
    return found


def licences(found: list[tuple[int, int, str, str]]) -> list[tuple[str, int, int]]:
    """(licence, first unit, last unit) by the ordered rules; no identifier is used twice."""
    _, _, rules = _known()
    used: set[int] = set()
    out = []
    for _, (name, ids) in rules:
        for start in range(len(found)):
            if start in used or found[start][2] != ids[0]:
                continue
            chain, k = [start], start
            for want in ids[1:]:
                end = found[k][0] + found[k][1]
                nxt = next((j for j in range(k + 1, len(found)) if j not in used and found[j][2] == want), None)
                if nxt is None or found[nxt][0] - end > MAX_GAP:
                    break
                chain.append(nxt)
                k = nxt
            if len(chain) == len(ids):
                used |= set(chain)
                version = next((found[j][3] for j in chain if found[j][3]), "")
                out.append((name.replace("-{n}", f"-{version}" if version else ""), found[start][0], found[k][0] + found[k][1] - 1))
    return sorted(out, key=lambda x: (x[1], x[2]))


SCHEMA = "doc_id long, n_sentences long, n_licenses long, licenses array<string>, matches array<struct<license:string,first_unit:int,last_unit:int>>"
_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("first_unit", pa.int32()), ("last_unit", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trigger = re.compile("|".join(map(re.escape, TRIGGERS)), re.I)
    for part in slices(batches, "text"):
        n, matches = [], []
        for text in part.column("text").to_pylist():
            found = sentences(text) if trigger.search(text) else []
            n.append(len(found))
            matches.append(licences(found))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": part.column("doc_id"),
                "n_sentences": pa.array(n, pa.int64()),
                "n_licenses": pa.array([len(m) for m in matches], pa.int64()),
                "licenses": pa.array([sorted({x[0] for x in m}) for m in matches], pa.list_(pa.string())),
                "matches": pa.array([[dict(zip(("license", "first_unit", "last_unit"), x)) for x in m] for m in matches], _MATCHES),
            }
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of known sentences, licences and where they stand, of each row; map-only."""
    return only(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
