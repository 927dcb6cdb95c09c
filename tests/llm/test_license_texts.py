"""Standard licence texts and headers as they are wrapped in files."""

from __future__ import annotations

import random
import re
import time

import pytest

from ledgerloom.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
KNOWN, WORD = licenses.compiled(licenses.SENTENCES), re.compile(licenses.NEEDED)


def scan(text):
    return licenses.recognise(text, KNOWN, licenses.RULES, WORD)


@pytest.mark.parametrize(("text", "name", "first", "last"), [
    (MIT, "MIT", "Permission is", "SOFTWARE."), (BSD3, "BSD-3-Clause", "Redistribution and", "permission."),
    (BSD3.replace("\n\n", "\n"), "BSD-3-Clause", "Redistribution and", "permission."), (BSD3.split("\n\n3.")[0], "BSD-2-Clause", "Redistribution and", "distribution."),
    (APACHE, "Apache-2.0", "Licensed under", "License at"),
    (GPL, "GPL-any", "This program is free", "this program."),
])
@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_texts(text, name, first, last, mark):
    whole = "\n".join(mark + line for line in ["Some words before", "", *text.split("\n"), "", "Some words after."])
    names, spans, _ = scan(whole)
    assert names == [name] and len(spans) == 1
    part = whole[spans[0]["start"] : spans[0]["end"]]
    assert part.lstrip(" *#/").startswith(first) and part.endswith(last)


def test_lines_and_clauses_still_stand_alone():
    assert scan("import os\nReleased under the MIT license\nimport re")[0] == ["MIT"]
    assert scan("Licence: released under the MIT license; thanks")[0] == ["MIT"]
    assert scan("Copyright (c) 2020, X\nAll rights reserved.")[0] == ["all-rights-reserved"]


def test_words_that_a_table_needs():
    assert all(re.search(licenses.needed_of([s]), t) for s, t in [(("x", "a(bc|de)+f?"), "ABC"), (("y", ".*"), ""), (("z", "(frob licence|quux).*"), "QUUX")])
    mine = (("frob", "frobnicate at will"),)
    assert licenses.recognise("You can\nfrobnicate\nat will", licenses.compiled(mine), (("F", ("frob",)),), re.compile(licenses.needed_of(mine)))[0] == ["F"]


def test_the_query_returns_all_spans(spark, tmp_path):
    spark.createDataFrame([(1, f"{MIT}\n\n{APACHE}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = licenses.op7_license_scan(spark, str(tmp_path)).first()
    assert row["licenses"] == "Apache-2.0,MIT" and [s["license"] for s in row["spans"]] == ["MIT", "Apache-2.0"]


def test_a_denied_licence_is_none():
    known, word = licenses.compiled(licenses.SENTENCES), re.compile(licenses.NEEDED)
    said = lambda t: licenses.recognise(t, known, licenses.RULES, word)[0]
    assert said("This is licensed under the GNU General Public License version 2.") == ["GPL-2.0-only"]
    for no in ("not", "never", "no longer", "not yet"):
        assert said(f"This is {no} licensed under the GNU General Public License version 2.") == []


@pytest.mark.parametrize(("text", "names"), [
    ("This work is not\nlicensed under the MIT license.", []), ("it isn't licensed under the\nGNU General Public License version 2.", []), ("Not for sale. Licensed under the MIT license.", ["MIT"]),
    ("licensed under the MIT License - see the LICENSE file for details", ["MIT"]), ("Licensed under the Apache License 2.0.", ["Apache-2.0"]), ("Licensed under GPL v3", ["GPL-3.0-only"]), ("License: GPLv2", ["GPL-2.0-only"]),
    ("https://creativecommons.org/licenses/by-nc/4.0/", ["CC-BY-NC-4.0"]), ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("distributed under the terms of the\n# BSD 3-Clause License", ["BSD-3-Clause"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy", ["MPL-2.0"]), ("published under the EPL 2.0", ["EPL-2.0"]), ("available under MIT umbrella terms", []), ("released under the moon", []),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", ["ISC"]),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published", ["LGPL"]),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published", ["AGPL-any"]),
])
def test_releases_and_notices(text, names):
    assert scan(text)[0] == names


def test_a_hundred_names_are_known():
    ids = {id_ for rows in licenses.names_of().values() for _, id_ in rows}
    assert len(ids) >= 100
    for line in licenses.NAMES.strip().splitlines():
        id_, names = line.split(":", 1)
        for name in names.split("|"):
            assert scan(f"This is released under the {name.strip()} license.")[0] == [id_], name


@pytest.mark.parametrize("text", ["the software license:\n" * 45000, "in no event shall the software is provided " * 25000, "licensed under the the the " * 40000, "1. " * 300000, "spdx-license-identifier: " + "a or " * 100000])
def test_long_texts_take_linear_time(text):
    t = time.time()
    scan(text)
    whole = time.time() - t
    assert whole < 20  # quadratic work would take minutes


def test_distant_parts_of_a_sentence_are_found():
    far = "In no event shall " + "the author or any other of the many holders " * 3000 + "be liable for any damage."
    assert scan(f"{MIT.split('IN NO EVENT')[0]}{far}")[1][0]["end"] == len(MIT.split("IN NO EVENT")[0] + far)
    assert scan("In no event shall it rain. Nobody shall be liable for any damage.")[2] == []


def brute_sentences(text):
    """Every known sentence at every word, by a regular expression over the words behind it; the leftmost and longest first."""
    words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*", text)]
    stops = [m.end() for m in re.finditer(r"[.!?]+(?=\s|$)", text)] + [len(text)]
    out, k = [], 0
    while k < len(words):
        stop = min(s for s in stops if s >= words[k][2])
        line = " ".join(w for w, _, e in words[k:] if e <= stop) + " "
        hits = []
        for name, head, tail, _ in KNOWN:
            m = re.match(" ".join(head) + " " + (".*? ??" + " ".join(tail) + " " if tail else ""), line)
            if m:
                hits.append((len(head), name, len(m.group().split())))
        if hits:
            _, name, n = max(hits)
            out.append(name)
            open_ = next(o for i, h, _, o in KNOWN if i == name)
            end = stop if open_ else words[k + n - 1][2]
            k = next((j for j, w in enumerate(words) if w[1] >= end), len(words))
        else:
            k += 1
    return out


def test_sentences_against_regular_expressions():
    rng = random.Random(12)
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            _, head, tail, _ = rng.choice(KNOWN)
            parts.append(" ".join([*head[: rng.choice([len(head), len(head), 3])], *rng.choices(["you", "the", "rain", "software"], k=rng.randrange(4)), *tail]) + rng.choice([".", " ", "!", "\n# "]))
        text = " ".join(parts)
        assert [x for x in scan(text)[2] if x != "copyright" and not x.startswith("release:")] == brute_sentences(text), text
