r"""Licence recognition by sentence rules.

A text is read once as words with their places; marks between words, such as those of comments and lists, count for
nothing. A table of known licence sentences, keyed by their first words, maps stretches of words to identifiers: a sentence
is its deciding words, which may leave a gap between two parts of it (``...``; both must stand in one sentence of the text)
and be open at its end, where it goes on to the end of the text's sentence. A second table maps names of licences to
their identifiers; "released under" and the like, followed by a name, is a known sentence of that licence. The sequence
of identifiers is then matched, from the left, against ordered rules: the first rule whose sequence stands there names
the licence and takes the sentences. Words between two known sentences end a sequence, but for list numbers and up to GLUE
words that are no sentence of their own.

A release that is denied ("not", "never", "isn't" and the like among the DENIED_WITHIN words before it in its sentence,
over any line breaks) names no licence. Every step is linear in the words of the text: however long a sentence is, its
two parts are found by their places, without a limit on the distance.

The tables of sentences, names and rules are parameters. Null and empty texts have no licence. Texts without any of the words
that a known sentence or a release has are not looked at more closely. Texts are read whole, however long. Repeated rows each
keep their row; columns named as the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from re import _parser
from re._constants import BRANCH, LITERAL, MAX_REPEAT, SUBPATTERN

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

#: Known sentences: identifier and words; (a|b) are alternatives, ``...`` between parts is a gap and at the end leaves it open.
SENTENCES = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ..."),
    ("mit-notice", "the above copyright notice and this permission notice ... shall be included in all copies or substantial portions of the software ..."),
    ("as-is", "(the|this) software is provided ... as is ..."),
    ("no-liability", "in no event shall ... be liable for any ..."),
    ("apache2-comply", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at ..."),
    ("gpl-free", "(|this )(program|software|file|code) is free software you can redistribute it and or modify it under the terms of the gnu general public license ..."),
    ("lgpl-free", "(|this )(library|program|software|file) is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license ..."),
    ("agpl-free", "(|this )(program|software|file|code) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license ..."),
    ("gpl-hope", "(|this )(program|library|software|file|code) is distributed in the hope that it will be useful but without any warranty ..."),
    ("gpl-more", "see the gnu (|lesser |library |affero )general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu (|lesser |library |affero )general public license ..."),
    ("bsd-redistribute", "redistribution and use in source and binary forms ... are permitted provided that the following conditions are met ..."),
    ("bsd-source", "redistributions of source code must retain the above copyright notice ..."),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice ..."),
    ("bsd-ads", "all advertising materials mentioning features or use of this software must display ..."),
    ("bsd-name", "neither the name of ... may be used to endorse or promote products ..."),
    ("isc-grant", "permission to use copy modify and (|or )distribute this software for any purpose with or without fee is hereby granted ..."),
    ("mpl2-form", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications ..."),
    ("boost-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license ..."),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document ..."),
    ("cc0", "(cc0 1.0 universal|no rights reserved)"),
    ("all-rights", "all rights reserved"),
)
#: Rules in order: licence and the identifiers that follow each other. A release is a rule of its own, and so is a tag.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-ads")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("release:Apache-2.0", "apache2-comply", "apache2-copy")),
    ("AGPL-any", ("agpl-free", "gpl-hope", "gpl-more", "gpl-copy")),
    ("AGPL-any", ("agpl-free",)),
    ("LGPL", ("lgpl-free", "gpl-hope", "gpl-more", "gpl-copy")),
    ("LGPL", ("lgpl-free",)),
    ("GPL-any", ("gpl-free", "gpl-hope", "gpl-more", "gpl-copy")),
    ("GPL-any", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("GPL-any", ("gpl-free",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("WTFPL", ("wtfpl",)),
    ("CC0-1.0", ("cc0",)),
    ("all-rights-reserved", ("all-rights",)),
)
#: Licences and the names that releases give them, without "the", "license" and "version"; x.0 may be written x.
NAMES = """
0BSD: 0bsd | bsd zero clause
AFL-3.0: afl 3.0 | academic free 3.0
AGPL-3.0-only: gnu affero general public 3.0 | gnu agpl 3.0 | agpl 3.0 | agplv3 | affero general public 3.0
AGPL-any: gnu affero general public | agpl | affero gpl
Apache-1.1: apache 1.1 | apache software 1.1
Apache-2.0: apache 2.0 | apache software 2.0 | apache public 2.0 | apache2 | apl 2.0 | asl 2.0
APSL-2.0: apple public source 2.0 | apsl 2.0
Artistic-1.0: artistic 1.0
Artistic-2.0: artistic 2.0
BlueOak-1.0.0: blue oak model 1.0.0 | blueoak 1.0.0
BSD-2-Clause: bsd 2 clause | 2 clause bsd | two clause bsd | simplified bsd | freebsd
BSD-3-Clause: bsd 3 clause | 3 clause bsd | three clause bsd | new bsd | modified bsd | revised bsd
BSD-4-Clause: bsd 4 clause | 4 clause bsd | original bsd | four clause bsd
BSD: bsd | bsd style
BSL-1.0: boost software 1.0 | boost 1.0 | bsl 1.0 | boost software
BUSL-1.1: business source 1.1 | busl 1.1
CAL-1.0: cryptographic autonomy 1.0
CC0-1.0: cc0 1.0 | cc0 1.0 universal | cc0 | creative commons zero 1.0 | creative commons zero | creative commons cc0 1.0 universal public domain dedication
CDDL-1.0: common development and distribution 1.0 | cddl 1.0 | cddl
CDDL-1.1: common development and distribution 1.1 | cddl 1.1
CECILL-2.1: cecill 2.1 | cecill
CPAL-1.0: common public attribution 1.0 | cpal 1.0
CPL-1.0: common public 1.0 | cpl 1.0
ECL-2.0: educational community 2.0 | ecl 2.0
EFL-2.0: eiffel forum 2.0
EPL-1.0: eclipse public 1.0 | epl 1.0
EPL-2.0: eclipse public 2.0 | epl 2.0
EUPL-1.1: european union public 1.1 | eupl 1.1
EUPL-1.2: european union public 1.2 | eupl 1.2 | eupl
FSL-1.1: functional source 1.1
GFDL-1.2: gnu free documentation 1.2 | gfdl 1.2
GFDL-1.3: gnu free documentation 1.3 | gfdl 1.3
GFDL-any: gnu free documentation | gfdl | gnu fdl
GPL-1.0-only: gnu general public 1.0 | gpl 1.0 | gplv1
GPL-2.0-only: gnu general public 2.0 | gnu gpl 2.0 | gpl 2.0 | gplv2 | gnu gplv2 | general public 2.0
GPL-3.0-only: gnu general public 3.0 | gnu gpl 3.0 | gpl 3.0 | gplv3 | gnu gplv3 | general public 3.0
GPL-any: gnu general public | gnu gpl | gpl
HPND: historical permission notice and disclaimer | hpnd
IPL-1.0: ibm public 1.0
ISC: isc
LaTeX2e: latex2e
LGPL-2.0-only: gnu library general public 2.0 | lgpl 2.0 | lgplv2
LGPL-2.1-only: gnu lesser general public 2.1 | lgpl 2.1 | lgplv2.1 | gnu lgpl 2.1
LGPL-3.0-only: gnu lesser general public 3.0 | lgpl 3.0 | lgplv3 | gnu lgpl 3.0
LGPL: gnu lesser general public | gnu library general public | gnu lgpl | lgpl
LPL-1.02: lucent public 1.02
LPPL-1.3c: latex project public 1.3c | lppl 1.3c
LPPL-any: latex project public | lppl
MIT: mit | expat | x11 mit | mit x11 | mit expat
MIT-0: mit 0 | mit no attribution
MPL-1.0: mozilla public 1.0 | mpl 1.0
MPL-1.1: mozilla public 1.1 | mpl 1.1
MPL-2.0: mozilla public 2.0 | mpl 2.0 | mplv2
MPL-any: mozilla public | mpl
MS-PL: microsoft public | ms pl
MS-RL: microsoft reciprocal | ms rl
MulanPSL-2.0: mulan psl 2.0 | mulan permissive software 2.0
NCSA: university of illinois ncsa open source | ncsa
NPL-1.1: netscape public 1.1
ODbL-1.0: open database 1.0 | odbl 1.0 | open database | odbl
ODC-By-1.0: open data commons attribution 1.0 | open data commons attribution
OFL-1.1: sil open font 1.1 | open font 1.1 | ofl 1.1 | sil ofl 1.1
OpenSSL: openssl
OSL-3.0: open software 3.0 | osl 3.0
PDDL-1.0: open data commons public domain dedication and | pddl 1.0 | pddl
PHP-3.01: php 3.01 | php
PolyForm-Noncommercial-1.0.0: polyform noncommercial 1.0.0
PostgreSQL: postgresql
PSF-2.0: python software foundation 2.0 | psf 2.0 | python software foundation | psf
QPL-1.0: q public 1.0 | qpl 1.0 | q public
RPL-1.5: reciprocal public 1.5
Ruby: ruby
SSPL-1.0: server side public 1.0 | sspl 1.0 | sspl
Sleepycat: sleepycat
SPL-1.0: sun public 1.0
Unlicense: unlicense
UPL-1.0: universal permissive 1.0 | upl 1.0 | upl
Vim: vim
W3C: w3c software notice and | w3c
WTFPL: wtfpl | do what the fuck you want to public
X11: x11
XFree86-1.1: xfree86 1.1
Zlib: zlib | zlib libpng
ZPL-2.1: zope public 2.1 | zpl 2.1
"""
#: Words of names of Creative Commons licences, part by part (fixed values), and their versions.
CC_PARTS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
CC_KINDS, CC_VERSIONS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Words that a name may have or lack, that stand between "under" and a name, and that release.
SKIPPED = frozenset("the version v license licence licenses".split())
LEADING = frozenset("the terms of a an this and conditions under following free permissive open source standard copyleft".split())
RELEASES = frozenset("released licensed licenced distributed redistributed available published provided covered offered".split())
#: Words that deny a release, and how many before it are looked at.
DENIALS = frozenset("not never nor neither no without cannot isn't isn’t aren't aren’t wasn't wasn’t don't don’t won't won’t can't can’t".split())
DENIED_WITHIN = 4
#: Words that may stand between two sentences of a licence.
GLUE = 3
WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*(?:['’]t\b)?")
#: Where a sentence of a text ends (a list number's dot is none), where only an open one does, and tags with their expressions.
STOP, COLON = re.compile(r"[.!?]+(?=\s|$|[\"'”)])"), re.compile(r":(?=\s|$)")
PARAGRAPH = re.compile(r"\n(?:[^\w\n]*\n)+|\n(?=[^\w\n]*\d{1,2}[.)]\s)|\n(?=[ \t]*[*-][ \t]+redistributions )", re.IGNORECASE)
TAG = re.compile(r"spdx-license-identifier:?[ \t]*(\(*[a-z0-9.+-]+(?:[ \t()]+(?:and|or|with)[ \t()]+[a-z0-9.+-]+\)*)*)", re.IGNORECASE)
URL = re.compile(r"creativecommons\.org/(?:licenses/([a-z-]+)/(\d\.\d)|(publicdomain/zero/1\.0))", re.IGNORECASE)
COPYRIGHT = re.compile(r"^[^\w\n(]*(?:copyright\b|\(c\)).*$", re.IGNORECASE | re.MULTILINE)
RELEASED = r"(?:" + "|".join(sorted(RELEASES)) + r")\W+under\b"
RESULT = "licenses array<string>, spans array<struct<start:long,end:long,license:string>>, sentences array<string>"


def expanded(pattern: str) -> list[str]:
    """Every way to read a pattern's alternatives."""
    m = re.search(r"\(([^()]*)\)", pattern)
    return [pattern] if not m else [x for option in m[1].split("|") for x in expanded(pattern[: m.start()] + option + pattern[m.end() :])]


def compiled(sentences) -> list[tuple[str, tuple[str, ...], tuple[str, ...], bool]]:
    """(identifier, words up to the gap, words behind it, whether the end is open)."""
    out = []
    for name, pattern in sentences:
        for one in expanded(pattern):
            parts = [tuple(WORD.findall(p)) for p in one.lower().split("...")]
            open_ = one.rstrip().endswith("...")
            out.append((name, parts[0], parts[1] if len(parts) > 1 else (), open_))
    return out


def names_of(text: str = NAMES) -> dict[str, list[tuple[tuple[str, ...], str]]]:
    """First word of a name -> (its words, licence), longest first."""
    rows = [(name.strip().split(), id_) for id_, names in (line.split(":", 1) for line in text.strip().splitlines()) for name in names.split("|")]
    for kind in CC_KINDS:
        for v in CC_VERSIONS:
            words, short = [CC_PARTS[p] for p in kind.split("-")], kind.split("-")
            for start, end in ((["creative", "commons", *words, v], []), (["cc", *short, v], []), (["creative", "commons", *short, v], []), (["creative", "commons", "cc", *short, v], [])):
                rows += [(start + end, f"CC-{kind.upper()}-{v}"), ([*start, "international"], f"CC-{kind.upper()}-{v}")]
    at = defaultdict(set)
    for words, id_ in rows:
        at[words[0]].add((tuple(words), id_))
        if words[-1].endswith(".0") and words[-1].count(".") == 1:
            at[words[0]].add((tuple([*words[:-1], words[-1][:-2]]), id_))
    return {k: sorted(v, key=lambda x: (-len(x[0]), x)) for k, v in at.items()}


def required(parsed) -> list[str] | None:
    """Words of which every match of a parsed pattern has one; None if there are none."""
    options, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is LITERAL:
            run += chr(value)
            continue
        options += [[w] for w in re.findall(r"[a-z0-9()]+", run)]
        run = ""
        if op is SUBPATTERN:
            options.append(required(value[-1]))
        elif op is BRANCH:
            each = [required(x) for x in value[1]]
            options.append(None if None in each else [w for x in each for w in x])
        elif op is MAX_REPEAT and value[0]:
            options.append(required(value[2]))
    return max((x for x in options if x), key=lambda x: min(map(len, x)), default=None)


def needed_of(sentences) -> str:
    """A pattern that every text with one of the sentences has a match of."""
    words = [required(_parser.parse(pattern)) for _, pattern in sentences]
    return "" if None in words else "(?i)" + "|".join(sorted({re.sub(r"([()])", r"\\\1", w) for x in words for w in x}))


#: Beside the sentences' own words, what a release, a tag or a link has.
NEEDED = needed_of(SENTENCES) + "|" + RELEASED + r"|spdx-license|creativecommons\.org|licen[cs]e:"


class Words:
    """The words of a text with their places, and for each the end of its sentence and of its clause."""

    def __init__(self, text: str):
        low = text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spans = [m.span() for m in WORD.finditer(low)]
        self.words = [low[a:b] for a, b in spans]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        marks = sorted({m.end() for m in STOP.finditer(text) if not self._number(text, m.start())} | {m.start() for m in PARAGRAPH.finditer(text)} | {len(text)})
        self.stops, self.clauses = marks, sorted({*marks, *(m.end() for m in COLON.finditer(text))})
        self.length = len(text)

    def _number(self, text: str, at: int) -> bool:
        """Whether the mark at ``at`` is the dot of a list number: digits at the beginning of their line."""
        return re.fullmatch(r"[^\w\n]*\d{1,2}", text[text.rfind("\n", 0, at) + 1 : at][-12:]) is not None

    def stop(self, place: int) -> int:
        return self.stops[min(bisect_left(self.stops, place), len(self.stops) - 1)]

    def clause(self, place: int) -> int:
        return self.clauses[min(bisect_left(self.clauses, place), len(self.clauses) - 1)]


def _name_at(w: Words, i: int, names) -> tuple[str, int] | None:
    """(licence, last word) of the longest name that begins at word i; a name of one word needs "license" beside it or an end behind it."""
    for words, id_ in names.get(w.words[i], ()) if i < len(w.words) else ():
        j, k = i, 0
        while j < len(w.words) and k < len(words):
            word = w.words[j]
            if word == words[k] or word == "v" + words[k]:
                k += 1
            elif word not in SKIPPED:
                break
            j += 1
        if k == len(words):
            last, named = j - 1, any(x in ("license", "licence") for x in w.words[i:j])
            while j < len(w.words) and j < last + 3 and w.words[j] in SKIPPED:
                named |= w.words[j] in ("license", "licence")
                last, j = j, j + 1
            if len(words) > 1 or named or w.clause(w.ends[last]) - w.ends[last] <= 1 or any(c in ",;)\n-" for c in w.text[w.ends[last] : w.ends[last] + 1]):
                return id_, last
    return None


def _release_at(w: Words, i: int, names) -> tuple[str, int] | None:
    """(licence, last word) of "released under NAME" at word i, a word that releases."""
    if i + 1 >= len(w.words) or w.words[i + 1] != "under":
        return None
    j = i + 2
    while j < len(w.words) and w.words[j] in LEADING and j < i + 12:
        hit = _name_at(w, j, names)
        if hit:
            return hit
        j += 1
    return _name_at(w, j, names)


def _denied(w: Words, i: int) -> bool:
    first = max(0, i - DENIED_WITHIN)
    begin = w.stops[k - 1] if (k := bisect_left(w.stops, w.starts[i] + 1)) else 0
    return any(w.words[j] in DENIALS for j in range(first, i) if w.starts[j] >= begin)


def known_sentences(text: str, known, names) -> list[tuple[int, int, str, str | None]]:
    """(start, end, identifier, licence of a release or tag) of the known sentences, from the left, none inside another."""
    w = Words(text)
    w.text = text
    by_word, tails = defaultdict(list), {}
    for name, head, tail, open_ in known:
        by_word[head[0]].append((head, tail, open_, name))
        if tail:
            tails[tail] = None
    for rows in by_word.values():
        rows.sort(key=lambda r: -len(r[0]))
    first_of = defaultdict(list)
    for tail in tails:
        first_of[tail[0]].append(tail)
    where: dict[tuple, list[int]] = {tail: [] for tail in tails}
    for i, word in enumerate(w.words):
        for tail in first_of.get(word, ()):
            if tuple(w.words[i : i + len(tail)]) == tail:
                where[tail].append(i)
    found = []
    for m in TAG.finditer(text):
        ids = [x.rstrip(".") for x in re.findall(r"[A-Za-z0-9.+-]+", m[1]) if x.lower() not in ("and", "or", "with")]
        written = {id_.lower(): id_ for rows in names.values() for _, id_ in rows}
        found += [(m.start(), m.end(), "spdx", written.get(x.lower(), x.upper())) for x in ids]
    for m in URL.finditer(text):
        found.append((m.start(), m.end(), "link", "CC0-1.0" if m[3] else f"CC-{m[1].upper().strip('-')}-{m[2]}"))
    found += [(m.start(), m.end(), "copyright", None) for m in COPYRIGHT.finditer(text)]
    i = 0
    while i < len(w.words):
        word, hit = w.words[i], None
        if word in RELEASES and (release := _release_at(w, i, names)):
            hit = (i, release[1], f"release:{release[0]}", False, release[0]) if not _denied(w, i) else None
        elif word in ("license", "licence") and text[w.ends[i] : w.ends[i] + 1] == ":" and i + 1 < len(w.words) and w.clause(w.ends[i] + 2) >= w.ends[i + 1] and (named := _name_at(w, i + 1, names)):
            hit = (i, named[1], f"release:{named[0]}", False, named[0])
        for head, tail, open_, name in by_word.get(word, ()) if not hit else ():
            if tuple(w.words[i : i + len(head)]) != head:
                continue
            last = i + len(head) - 1
            if tail:
                at = bisect_left(where[tail], last + 1)
                if at == len(where[tail]) or w.starts[where[tail][at]] >= w.stop(w.ends[last]):
                    continue
                last = where[tail][at] + len(tail) - 1
            if not (len(head) < 4 and not tail and _denied(w, i)):
                hit = (i, last, name, open_, None)
                break
        if not hit:
            i += 1
            continue
        first, last, name, open_, release = hit
        end = w.ends[last]
        if open_:
            end = max(end, w.clause(end))
            end -= len(text[:end]) - len(text[:end].rstrip()) if text[end - 1 : end].isspace() else 0
        elif text[end : end + 1] in (".", "!", "?"):
            end += 1
        found.append((w.starts[first], end, name, release))
        i = bisect_left(w.starts, end)
    out, reach = [], -1
    for row in sorted(found, key=lambda f: (f[0], -f[1])):
        if row[0] >= reach or row[2] == "spdx" and out and out[-1][2] == "spdx" and out[-1][0] == row[0]:
            out.append(row)
            reach = row[1]
    return out


def _joined(text: str, end: int, start: int) -> bool:
    """Whether what stands between two sentences leaves them next to each other."""
    between = text[end:start]
    if len(between) > 400:
        return False
    words = [m for m in WORD.finditer(between.lower()) if not re.fullmatch(r"\d{1,2}", m[0])]
    return len(words) <= GLUE and not any(re.match(r"[.!?](?=\s|$)", between[m.end() :]) for m in words)


def recognise(text: str, known, rules, needed: re.Pattern, names=None) -> tuple[list[str], list[dict], list[str]]:
    """(licences, spans, identifiers) of one text."""
    if not needed.search(text):
        return [], [], []
    found = known_sentences(text, known, names_of() if names is None else names)
    spans, k = [], 0
    while k < len(found):
        runs = 1
        title = found[k][3]
        for licence, sequence in rules:
            n = len(sequence)
            if tuple(f[2] for f in found[k : k + n]) == tuple(sequence) and all(_joined(text, found[j][1], found[j + 1][0]) for j in range(k, k + n - 1)):
                title, runs = licence, n
                break
        if title:
            spans.append({"start": found[k][0], "end": found[k + runs - 1][1], "license": title})
        k += runs
    return sorted({s["license"] for s in spans}), spans, [f[2] for f in found]


def with_licenses(docs: DataFrame, text_col: str = "text", sentences=SENTENCES, rules=RULES, needed: str | None = None, names: str = NAMES) -> DataFrame:
    """``docs`` with licenses (sorted), spans (start, end in code points, licence) and the identifiers met."""
    if needed is None:
        needed = NEEDED if sentences is SENTENCES else needed_of(sentences) + "|" + RELEASED + r"|spdx-license|creativecommons\.org|licen[cs]e:"

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        known, word, named = compiled(sentences), re.compile(needed), names_of(names)
        return pd.DataFrame([recognise(t, known, rules, word, named) if t else ([], [], []) for t in texts], columns=["licenses", "spans", "sentences"])

    # texts without a needed word go to Python as null
    told = F.when(F.col(text_col).rlike(needed), F.col(text_col))
    got = docs.withColumn("__ll_lic", scan(told))
    return got.withColumns({c: F.col(f"__ll_lic.{c}") for c in ("licenses", "spans", "sentences")}).drop("__ll_lic")


def op7_license_scan(spark, sf_dir):
    docs = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    first = F.element_at(F.col("spans"), 1)
    return docs.select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("spans").cast("long").alias("n_spans"),
        F.when(F.size("spans") > 0, first["start"]).alias("first_start"), F.when(F.size("spans") > 0, first["end"]).alias("first_end"), F.array_join("sentences", ",").alias("sentences"), "spans",
    )
