"""License scans by sentence rules: sentences become identifiers, identifier sequences match ordered rules.

A paragraph is read as its normalised words (lower case, letters and digits only), so that line breaks, comment
marks and quotes inside a sentence do not matter. Three kinds of known sentences become identifiers: sentences of
licence texts (``SENTENCES``), statements that put something under a named licence, and lines that are a licence's
name (both by ``NAMES``). SPDX tags are read from the raw text as expressions. Rules are sequences of
identifiers; they are tried in the order listed at every place of the sequence, and the first that fits there takes
its sentences, so longer and more specific rules stand before the ones they contain. Identifiers that no rule takes
are reported as unmatched. No sentence is too long and none spans too many lines; the work grows with the text's
length, as the places of a phrase that continues a sentence are listed once a paragraph.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import id_and_text

# Identifier and pattern of the normalised sentences of licence texts. " ... " stands for any words of the
# same paragraph, " .. " for any of the same line, a final " ..." for the rest of the sentence, a final " ..|" for the rest of the line.
SENTENCES = (
    ("copyright", r"(?:portions )?copyright (?:c )?(?:\d{4}|the \w+) ..|"),
    ("copyright", r"(?:portions )?copyright .. \d{4} ..|"),
    ("all-rights", r"all rights reserved"),
    ("apache-comply", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at ..."),
    ("apache-asis", r"unless required by applicable law or agreed to in writing (?:software|work) distributed under the license is distributed on an as is basis ..."),
    ("apache-limits", r"see the license for the specific language governing permissions and limitations(?: under the license)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ..."),
    ("mit-notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit-asis", r"the software is provided as is without warranty of any kind express or implied ..."),
    ("mit-liability", r"in no event shall ... be liable for any claim ..."),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation ..."),
    ("boost-notice", r"the copyright notices in the software and this entire statement ... must be included in all copies of the software ..."),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided ..."),
    ("0bsd-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-asis", r"the software is provided as is and ... disclaims? all warranties ..."),
    ("hpnd-grant", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose ..."),
    ("bsd-grant", r"redistribution and use in source and binary forms ... are permitted ..."),
    ("bsd-source", r"(?:\d )?redistributions of source code must retain the above copyright notice ..."),
    ("bsd-binary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice ..."),
    ("bsd-advert", r"(?:\d )?all advertising materials mentioning features or use of this software must display the following acknowledge?ment ..."),
    ("bsd-endorse", r"(?:\d )?neither the names? of ... may be used to endorse or promote products ..."),
    ("bsd-endorse", r"(?:\d )?the names? of ... may not be used to endorse or promote products ..."),
    ("bsd-asis", r"this software is provided by ... as is and any express or implied warranties ..."),
    ("gpl-hope", r"this \w+ is distributed in the hope that it will be useful ..."),
    ("gpl-copy", r"you should have received a copy of the gnu (?:affero |lesser |library )?general public license ..."),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file you can obtain one at ..."),
    ("zlib-asis", r"this software is provided as is without any express or implied warranty ..."),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose ..."),
    ("zlib-origin", r"(?:\d )?the origin of this software must not be misrepresented ..."),
    ("zlib-altered", r"(?:\d )?altered source versions must be plainly marked as such ..."),
    ("zlib-notice", r"(?:\d )?this notice may not be removed or altered from any source distribution ..."),
    ("unlicense-head", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-grant", r"anyone is free to copy modify publish use compile sell or distribute this software ..."),
    ("wtfpl-terms", r"(?:\d )?you just do what the fuck you want to"),
    ("beerware-head", r"as long as you retain this notice you can do whatever you want with this stuff ..."),
    ("openssl-head", r"this product includes software developed by the openssl project ..."),
    ("ofl-head", r"this font software is licensed under the sil open font license version 1 1 ..."),
    ("cc0-waiver", r"to the extent possible under law ... has waived all copyright and related or neighboring rights ..."),
    ("public-domain", r"this (?:work|file|software|program|code) is in the public domain"),
    ("public-domain", r"(?:this (?:work|file|software|program|code) (?:is|has been) )?(?:placed|released) (?:in|into) the public domain"),
    ("confidential", r"unauthori[sz]ed copying of this file ... is strictly prohibited ..."),
    ("confidential", r"this (?:software|document|file|program) (?:is|contains) (?:proprietary and confidential|confidential and proprietary) ..."),
)
# Stem of the identifier, licence, and pattern of the names a statement or a title may use. In a licence
# "{v}" stands for the version that the name gives; without one the
# licence has none. The longest name that fits is taken, of equally long ones the first.
NAMES = (
    ("apache", "Apache-{v}", r"apache(?: software)?(?: public)? licen[sc]e(?: (?:version|v) ?(\d)(?: (\d))?| (\d) (\d))?|(?:apache|asl) ?(?:version )?v?(\d) (\d)"),
    ("mit0", "MIT-0", r"mit no attribution(?: licen[sc]e)?|mit 0 licen[sc]e"),
    ("mit", "MIT", r"(?:mit|expat)(?: x11| expat)?(?: open source| style)?(?: licen[sc]e(?: mit)?)?"),
    ("x11", "X11", r"x11(?: licen[sc]e)?"),
    ("isc", "ISC", r"isc licen[sc]e(?: isc)?|isc"),
    ("0bsd", "0BSD", r"(?:bsd )?zero clause(?: bsd)?(?: licen[sc]e)?|0bsd(?: licen[sc]e)?"),
    ("bsd4", "BSD-4-Clause", r"(?:original |4 clause |four clause )bsd(?: licen[sc]e)?|bsd (?:4|four) clause(?: licen[sc]e)?"),
    ("bsd3", "BSD-3-Clause", r"(?:new |modified |revised |3 clause |three clause )bsd(?: licen[sc]e)?|bsd (?:3|three) clause(?: new| revised)?(?: licen[sc]e)?"),
    ("bsd2", "BSD-2-Clause", r"(?:simplified |freebsd |2 clause |two clause )bsd(?: licen[sc]e)?|bsd (?:2|two) clause(?: simplified)?(?: licen[sc]e)?"),
    ("bsd", "BSD", r"bsd(?: style)?(?: licen[sc]e)?"),
    ("agpl", "AGPL-{v}", r"gnu affero general public licen[sc]e{gnu}|(?:gnu )?agpl{gnu}"),
    ("lgpl", "LGPL-{v}", r"gnu (?:lesser|library) general public licen[sc]e{gnu}|(?:gnu )?lgpl{gnu}"),
    ("fdl", "GFDL-{v}", r"gnu free documentation licen[sc]e{gnu}|(?:gnu )?g?fdl{gnu}"),
    ("gpl", "GPL-{v}", r"gnu(?: general)? public licen[sc]e{gnu}|(?:gnu )?gpl{gnu}"),
    ("mpl", "MPL-{v}", r"mozilla public licen[sc]e{version}|mpl{version}"),
    ("epl", "EPL-{v}", r"eclipse public licen[sc]e{version}|epl{version}"),
    ("edl", "BSD-3-Clause", r"eclipse distribution licen[sc]e{version}"),
    ("eupl", "EUPL-{v}", r"european union public licen[sc]e{version}|eupl{version}"),
    ("cddl", "CDDL-{v}", r"common development and distribution licen[sc]e{version}|cddl{version}"),
    ("cpl", "CPL-{v}", r"common public licen[sc]e{version}"),
    ("ipl", "IPL-{v}", r"ibm public licen[sc]e{version}"),
    ("boost", "BSL-1.0", r"boost software licen[sc]e{version}"),
    ("zlib", "Zlib", r"zlib(?: libpng)? licen[sc]e|zlib"),
    ("libpng", "Libpng", r"libpng licen[sc]e"),
    ("unlicense", "Unlicense", r"unlicen[sc]e"),
    ("wtfpl", "WTFPL", r"do what the fuck you want to public licen[sc]e{version}|wtfpl{version}"),
    ("artistic", "Artistic-{v}", r"(?:perl )?artistic licen[sc]e{version}"),
    ("php", "PHP-{v}", r"php licen[sc]e(?: version (\d) (\d\d?))?"),
    ("python", "PSF-2.0", r"(?:python software foundation|psf) licen[sc]e(?: version 2)?"),
    ("ruby", "Ruby", r"ruby(?: s)? licen[sc]e"),
    ("openssl", "OpenSSL", r"openssl licen[sc]e"),
    ("postgresql", "PostgreSQL", r"postgresql licen[sc]e"),
    ("ncsa", "NCSA", r"(?:university of illinois )?(?:ncsa )?(?:university of illinois )?ncsa open source licen[sc]e"),
    ("ofl", "OFL-{v}", r"(?:sil )?open font licen[sc]e{version}"),
    ("upl", "UPL-1.0", r"universal permissive licen[sc]e{version}"),
    ("mspl", "MS-PL", r"microsoft public licen[sc]e(?: ms pl)?|ms pl"),
    ("msrl", "MS-RL", r"microsoft reciprocal licen[sc]e(?: ms rl)?|ms rl"),
    ("osl", "OSL-{v}", r"open software licen[sc]e{version}"),
    ("afl", "AFL-{v}", r"academic free licen[sc]e{version}"),
    ("blueoak", "BlueOak-1.0.0", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    ("mulan", "MulanPSL-{v}", r"mulan psl{version}|mulan permissive software licen[sc]e{version}"),
    ("odbl", "ODbL-1.0", r"(?:odc )?open (?:data commons open )?database licen[sc]e{version}|odbl"),
    ("odcby", "ODC-By-1.0", r"open data commons attribution licen[sc]e{version}"),
    ("pddl", "PDDL-1.0", r"(?:open data commons )?public domain dedication (?:and|&) licen[sc]e{version}|pddl"),
    ("cecill", "CECILL-{v}", r"cecill(?: free software)?(?: licen[sc]e)?{version}"),
    ("busl", "BUSL-1.1", r"business source licen[sc]e{version}"),
    ("sspl", "SSPL-1.0", r"server side public licen[sc]e{version}"),
    ("elastic", "Elastic-{v}", r"elastic licen[sc]e{version}"),
    ("cc0", "CC0-1.0", r"(?:creative commons zero|creative commons cc0|cc0|cc 0)(?: (?:version |v)?1 0)?(?: universal)?(?: public domain dedication| licen[sc]e)?"),
    ("cc", "CC", r"(?:creative commons|cc)((?: (?:by|nc|nd|sa|attribution|non ?commercial|no ?deriv(?:ative)?s|no ?derivative works|share ?alike))+)(?: (?:version |v)?(\d) (\d))?(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?"),
)
_VERSION = r"(?: (?:version|v) ?(\d)(?: (\d)\b)?| ?v?(\d) (\d)| v?(\d))?"
_GNU = r"(?: as published by the free software foundation)?(?:(?: either)? ?(?:version|v)? ?(\d)\b(?: (\d)\b)?(?: of the licen[sc]e)?)?(?: (only)\b| (or (?:at your option )?(?:any )?(?:later|newer)(?: version)?))?"
# Licence (None: the one its statement names) and the identifiers that stand for it, in order; "?" marks a sentence that may be missing.
RULES = (
    (None, ("apache-name?", "copyright?", "apache-head", "apache-comply?", "apache-copy?", "apache-asis?", "apache-limits?")),
    ("Apache-2.0", ("apache-comply", "apache-copy?", "apache-asis?", "apache-limits?")),
    ("BSL-1.0", ("boost-name?", "boost-grant", "boost-notice?", "mit-asis?", "mit-liability?")),
    ("MIT-0", ("mit0-name", "copyright?", "all-rights?", "mit-grant", "mit-asis?", "mit-liability?")),
    ("MIT", ("mit-name?", "copyright?", "all-rights?", "mit-grant", "mit-notice?", "mit-asis?", "mit-liability?")),
    ("ISC", ("isc-name?", "copyright?", "all-rights?", "isc-grant", "isc-asis?")),
    ("0BSD", ("0bsd-name?", "copyright?", "all-rights?", "0bsd-grant", "isc-asis?")),
    ("HPND", ("copyright?", "all-rights?", "hpnd-grant")),
    ("BSD-4-Clause", ("bsd4-name?", "copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-asis?")),
    ("BSD-3-Clause", ("bsd3-name?", "copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis?")),
    ("BSD-2-Clause", ("bsd2-name?", "copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-asis?")),
    ("BSD-1-Clause", ("copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-asis?")),
    ("BSD", ("copyright?", "all-rights?", "bsd-grant", "bsd-asis?")),
    ("Zlib", ("zlib-name?", "copyright?", "zlib-asis?", "zlib-grant", "zlib-origin", "zlib-altered?", "zlib-notice?")),
    ("Unlicense", ("unlicense-name?", "unlicense-head", "unlicense-grant?", "mit-asis?", "mit-liability?")),
    ("WTFPL", ("wtfpl-name?", "copyright?", "wtfpl-name?", "wtfpl-terms")),
    ("Beerware", ("beerware-head",)),
    ("OpenSSL", ("openssl-head",)),
    ("OFL-1.1", ("copyright?", "ofl-head", "ofl-name?")),
    ("CC0-1.0", ("cc0-waiver",)),
    *((None, (f"{stem}-name?", f"{stem}-head", "gpl-hope?", "gpl-copy?")) for stem in ("agpl", "lgpl", "gpl")),
    (None, ("mpl-name?", "mpl-head", "mpl-copy?")),
    ("MPL-2.0", ("mpl-copy",)),
    ("public-domain", ("public-domain",)),
    ("proprietary", ("copyright", "all-rights", "confidential?")),
    ("proprietary", ("confidential",)),
    (None, ("spdx",)),
    *((None, (f"{stem}-{kind}",)) for stem, _, _ in NAMES for kind in ("head", "name")),
)
#: Exact names of identifiers in SPDX tags; others are kept as they are written.
SPDX = {
    x.lower(): x
    for x in ("MIT", "MIT-0", "X11", "ISC", "0BSD", "Apache-2.0", "Apache-1.1", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "MPL-2.0", "EPL-2.0",
              *(f"{g}GPL-{v}{end}" for g in ("", "L", "A") for v in ("2.0", "2.1", "3.0") for end in ("", "-only", "-or-later")))
}
#: A paragraph with none of these and no short name after a preposition holds no known sentence, and is not cut up.
_HINTS = (
    "licen", "copyright", "permission", "redistribut", "warrant", "domain", "reserved", "spdx", "wtfpl", "misrepresented", "altered", "unencumbered", "compile",
    "advertising", "endorse", "liable", "useful", "mpl", "fuck", "stuff", "openssl", "waived", "prohibited", "confidential", "creative",
)
_SHORT = tuple(
    re.compile(
        before + r"\W+(?:(?:either|both|the|an?|terms|and|conditions|of)\W+)*"
        r"(?:mit|expat|x11|isc|(?:\w+\W+){0,2}0?bsd|bsd|zero|(?:gnu\W+)?[al]?gpl|(?:gnu\W+)?g?fdl|epl|eupl|cddl|zlib|apache|asl|cc|cc0|odbl|pddl|cecill|mulan|ms)(?=v?\d|[\W_]|\Z)"
    )
    for before in ("under", r"governed\W+by", r"covered\W+by", r"subject\W+to", r"dedicated\W+to")
)
_PARAGRAPHS = re.compile(r"\n[^\w\n]*(?:\n[^\w\n]*)+")
_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?;:]\W*\s")
_TAG = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*", re.I)
_PLAIN = r"[A-Za-z0-9]+(?:[.+-]+[A-Za-z0-9]+)*\+?"
_ITEM = re.compile(rf"[ \t(]*({_PLAIN})(?:[ \t]+WITH[ \t]+({_PLAIN}))?[ \t)]*", re.I)
_JOINED = re.compile(r"(?:AND|OR)\b", re.I)


@cache
def _names() -> tuple[tuple[str, str, re.Pattern], ...]:
    fill = lambda p: p.replace("{version}", _VERSION).replace("{gnu}", _GNU)
    return tuple((stem, licence, re.compile(rf"(?:{fill(pattern)})\b")) for stem, licence, pattern in NAMES)


@cache
def _known() -> tuple[tuple[str, re.Pattern, tuple[tuple[str, re.Pattern], ...], str], ...]:
    """Identifier, first phrase, later ones (each after the gap before it), and what follows the last: "" (nothing), "line" or "sentence"."""
    out = []
    for name, pattern in SENTENCES:
        tail = "line" if pattern.endswith(" ..|") else "sentence" if pattern.endswith(" ...") else ""
        parts = re.split(r" (\.{2,3}) ", pattern.removesuffix(" ..|").removesuffix(" ..."))
        phrases = [re.compile(rf"\b(?:{p})\b") for p in parts[::2]]
        out.append((name, phrases[0], tuple(zip(parts[1::2], phrases[1:])), tail))
    return tuple(out)


#: A statement that puts something under a licence, up to the licence's name.
_UNDER = re.compile(
    r"(?<!not )\b(?:(?:licen[sc]ed|released|distributed|available|published|covered|provided|redistributed|dedicated|modify it|used|open sourced) under|(?:governed|covered) by|subject to|dedicated to)"
    r"(?: either| both)?(?: the terms(?: and conditions)? of)?(?: either| both)?(?: (?:the|an?))?(?: (?:terms(?: and conditions)? of|public domain under))?(?: the)? "
)
#: How a sentence of ``SENTENCES`` begins, and what makes a name a title.
_BEGINS = re.compile(r"(?:\d )?(?:portions|copyright|all|you|unless|see|permission|the|in|redistributions?|neither|this|if|altered|anyone|as|to|unauthori[sz]ed|placed|released)\b")
_TITLE = re.compile("licen[sc]e|wtfpl")
_MORE = re.compile(r" (?:and or|and|or|as well as)(?: under)?(?: the terms(?: and conditions)? of)?(?: (?:the|an?))? ")


def _license(licence: str, m: re.Match) -> str:
    """The licence that a matched name stands for."""
    if licence == "CC":
        given = re.sub(r"\bnon ?commercial\b", "nc", m[1])
        given = re.sub(r"\bshare ?alike\b", "sa", re.sub(r"\bno ?deriv\w*(?: works)?", "nd", given)).replace("attribution", "by").split()
        return "-".join(["CC", *(p.upper() for p in ("by", "nc", "nd", "sa") if p in given), *([f"{m[2]}.{m[3]}"] if m[2] else [])])
    if "{v}" not in licence:
        return licence
    digits = [g for g in m.groups() if g and g.isdigit()]
    version = f"{digits[0]}.{digits[1] if len(digits) > 1 else 0}" if digits else ""
    words = [g for g in m.groups() if g and not g.isdigit()]
    end = "" if not words or not digits else "-only" if words[0] == "only" else "-or-later"
    return licence.replace("{v}", version).rstrip("-") + end


def _name_at(line: str, place: int) -> tuple[str, str, int] | None:
    """Stem, licence and end of the licence's name at a place of the normalised words."""
    best = None
    for stem, licence, pattern in _names():
        m = pattern.match(line, place)
        if m and (best is None or m.end() > best[2]):
            best = stem, _license(licence, m), m.end()
    return best


def _tags(text: str) -> list[tuple[int, int, int, str, tuple[str, ...]]]:
    """SPDX tags: start, end of what was read, end, identifier and all licences of the expression."""
    out = []
    for tag in _TAG.finditer(text):
        found, place = [], tag.end()
        while item := _ITEM.match(text, place):
            licence = SPDX.get(item[1].lower(), item[1])
            found.append(f"{licence} WITH {item[2]}" if item[2] else licence)
            end = item.end(2) if item[2] else item.end(1)
            joint = _JOINED.match(text, item.end())
            if joint is None:
                break
            place = joint.end()
        if found:
            out.append((tag.start(), end, end, "spdx", tuple(found)))
    return out


def _paragraph(text: str, base: int) -> list[tuple[int, int, int, str, tuple[str, ...]]]:
    """Known sentences of one paragraph, as ``_tags`` returns them, places counted from ``base`` on."""
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    line, at = " ".join(words), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    # What stands before each word (and after the last): 3 end of a sentence, 2 of a line, 1 a mark inside one, 0 blanks.
    marks = [3]
    for (_, b), (a, _) in zip(spans, spans[1:]):
        gap = text[b:a]
        marks.append(0 if gap == " " else 3 if _STOP.search(gap) else 2 if "\n" in gap else 0 if gap.isspace() else 1)
    marks.append(3)
    line_ends = [k for k in range(1, len(marks)) if marks[k] >= 2]
    sentence_ends = [k for k in line_ends if marks[k] == 3]
    found: list[tuple[int, int, int, str, tuple[str, ...]]] = []  # in word numbers

    def upto(place: int) -> int:
        return bisect_left(at, place)

    for m in _UNDER.finditer(line):
        first, place, names = upto(m.start()), m.end(), []
        while name := _name_at(line, place):
            names.append((name, place))
            joint = _MORE.match(line, name[2])
            if joint is None:
                break
            place = joint.end()
        for k, ((stem, licence, end), start) in enumerate(names):
            z = upto(end)
            if text[spans[z - 1][1] : spans[z - 1][1] + 1] == "+" and re.search(r"GPL-\d\.\d$", licence):
                licence += "-or-later"
            found.append((first if k == 0 else upto(start), z, z, f"{stem}-head", (licence,)))
    places: dict[re.Pattern, list[tuple[int, int]]] = {}
    for k in range(len(words)):
        if marks[k] < 2:
            continue
        place = at[k]
        if _BEGINS.match(line, place):
            for name, first_phrase, others, tail in _known():
                m = first_phrase.match(line, place)
                if m is None:
                    continue
                end = m.end()
                for gap, phrase in others:
                    if phrase not in places:
                        places[phrase] = [p.span() for p in phrase.finditer(line)]
                    i = bisect_left(places[phrase], (end, 0))
                    if i == len(places[phrase]) or gap == ".." and upto(places[phrase][i][1]) > line_ends[bisect_left(line_ends, k + 1)]:
                        break
                    end = places[phrase][i][1]
                else:
                    core = upto(end)
                    ends = sentence_ends if tail == "sentence" else line_ends
                    if tail or marks[core] >= 1:
                        found.append((k, core, ends[bisect_left(ends, core)] if tail else core, name, ()))
        title = _name_at(line, place + 4 if line.startswith("the ", place) else place)
        if title and _TITLE.search(line, place, title[2]) and marks[upto(title[2])] >= 1:
            found.append((k, upto(title[2]), upto(title[2]), f"{title[0]}-name", (title[1],)))

    def after(k: int) -> int:
        end = spans[k - 1][1]
        return base + end + (text[end : end + 1] == "+")  # a plus after a version is part of the name

    return [(base + spans[a][0], after(core), after(z), name, licences) for a, core, z, name, licences in found]


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in _HINTS) or any(p.search(low) for p in _SHORT)


def sentences(text: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """Start, end, identifier and licences named of the known sentences of a text, none overlapping another.

    Of overlapping ones the first stays, of those with one start the longest. The rest of a sentence that only
    follows a known beginning ends where the next known sentence begins.
    """
    if not _hinted(text):
        return []
    found = _tags(text)
    cuts = [0, *[x for m in _PARAGRAPHS.finditer(text) for x in m.span()], len(text)]
    for base, end in zip(cuts[::2], cuts[1::2]):
        if _hinted(text[base:end]):
            found += _paragraph(text[base:end], base)
    out: list[list] = []
    for start, core, end, name, licences in sorted(found, key=lambda f: (f[0], -f[1], f[3])):
        if out and start < out[-1][4]:
            continue
        if out:
            out[-1][1] = min(out[-1][1], start)
        out.append([start, end, name, licences, core])
    return [(start, len(text[start:end].rstrip()) + start, name, licences) for start, end, name, licences, _ in out]


def match(ids: list[str]) -> list[tuple[str | None, int, int]]:
    """Licence ("": the one its statement names, None: unmatched) and first and last-plus-one place of every part of an identifier sequence."""
    out, i = [], 0
    while i < len(ids):
        for licence, rule in RULES:
            j = i
            for step in rule:
                if j < len(ids) and ids[j] == step.rstrip("?"):
                    j += 1
                elif not step.endswith("?"):
                    j = -1
                    break
            if j > i:
                out.append((licence or "", i, j))
                i = j
                break
        else:
            out.append((None, i, i + 1))
            i += 1
    return out


def scan(text: str) -> tuple[list[dict], list[str], list[str]]:
    """Licences with their spans, all identifiers, and those no rule took (copyright lines alone are no licence)."""
    found = sentences(text)
    ids = [s[2] for s in found]
    licences, left = [], []
    for licence, a, b in match(ids):
        named = [s[3] for s in found[a:b] if s[3]]
        if licence is None:
            left.append(ids[a])
        else:
            for one in (licence,) if licence else named[-1]:
                licences.append({"license": one, "start": found[a][0], "end": found[b - 1][1]})
    return licences, ids, left


_SPANS = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan(t.as_py()) for t in batch["text"]]
        names = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([f[0] for f in found], _SPANS), pa.array([f[1] for f in found], names), pa.array([f[2] for f in found], names)],
            names=["doc_id", "spans", "sentence_ids", "unmatched"],
        )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: doc_id, licenses (sorted, distinct), spans, sentence_ids, unmatched.

    Null and empty texts hold none. Repeated rows are scanned each on its own; a null doc_id is carried along.
    """
    kind = "doc_id long, spans array<struct<license:string,start:long,end:long>>, sentence_ids array<string>, unmatched array<string>"
    found = id_and_text(docs, id_col, text_col).mapInArrow(_scan, kind)
    return found.select(
        "doc_id", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["license"]))).alias("licenses"), "spans", "sentence_ids", "unmatched"
    )
