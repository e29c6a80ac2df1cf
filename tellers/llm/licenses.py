"""License scans: known sentences become identifiers, and rules match their sequences."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.llm.batches import with_text_columns
from tellers.llm.text import whole_text

# Names of licenses in normalised text, by identifier. Longer names of
# a family come first.
NAMES = {
    "AGPL-3.0": r"gnu affero general public license(?: version| v)? ?3(?: 0)?|agpl(?: v)? ?3(?: 0)?",
    "LGPL-2.1": r"gnu lesser general public license(?: version| v)? ?2 1|lgpl(?: v)? ?2 1",
    "LGPL-3.0": r"gnu lesser general public license(?: version| v)? ?3(?: 0)?|lgpl(?: v)? ?3(?: 0)?",
    "GPL-2.0": r"gnu general public license(?: version| v)? ?2(?: 0)?|gpl(?: v)? ?2(?: 0)?",
    "GPL-3.0": r"gnu general public license(?: version| v)? ?3(?: 0)?|gpl(?: v)? ?3(?: 0)?",
    "Apache-2.0": r"apache license(?: version| v)? ?2(?: 0)?|apache 2(?: 0)?(?: license)?",
    "MPL-2.0": r"mozilla public license(?: version| v)? ?2(?: 0)?|mpl 2 0",
    "BSD-3-Clause": r"(?:bsd 3 clause|3 clause bsd)(?: license)?",
    "BSD-2-Clause": r"(?:bsd 2 clause|2 clause bsd)(?: license)?",
    "MIT": r"mit(?: license)?",
    "ISC": r"isc(?: license)?",
    "CC0-1.0": r"(?:creative commons zero|cc0)(?: 1 0)?",
    "Unlicense": r"unlicense",
    "0BSD": r"0bsd|bsd zero clause(?: license)?",
    "AFL-3.0": r"academic free license(?: version| v)? ?3(?: 0)?",
    "Artistic-2.0": r"artistic license(?: version| v)? ?2(?: 0)?",
    "BSL-1.0": r"boost software license(?: version| v)?(?: 1 0)?",
    "CDDL-1.0": r"common development and distribution license(?: version| v)?(?: 1 0)?|cddl 1 0",
    "EPL-1.0": r"eclipse public license(?: version| v)? ?1(?: 0)?|epl(?: v)? ?1(?: 0)?",
    "EPL-2.0": r"eclipse public license(?: version| v)? ?2(?: 0)?|epl(?: v)? ?2(?: 0)?",
    "EUPL-1.1": r"european union public licen[cs]e(?: version| v)? ?1 1|eupl(?: v)? ?1 1",
    "EUPL-1.2": r"european union public licen[cs]e(?: version| v)? ?1 2|eupl(?: v)? ?1 2",
    "LGPL-2.0": r"gnu library general public license(?: version| v)? ?2(?: 0)?|lgpl(?: v)? ?2 0",
    "MS-PL": r"microsoft public license|ms pl",
    "ODbL-1.0": r"open database license(?: version| v)?(?: 1 0)?|odbl(?: 1 0)?",
    "OFL-1.1": r"sil open font license(?: version| v)?(?: 1 1)?",
    "PostgreSQL": r"postgresql license",
    "WTFPL": r"wtfpl|do what the fuck you want to public license",
    "Zlib": r"zlib(?: license)?",
}
_CREATIVE_COMMONS = {  # the longer names first
    "BY-NC-SA": "noncommercial sharealike", "BY-NC-ND": "noncommercial noderivatives", "BY-NC": "noncommercial",
    "BY-SA": "sharealike", "BY-ND": "noderivatives", "BY": "",
}
for _kind, _words in _CREATIVE_COMMONS.items():
    for _version in ("4.0", "3.0", "2.5", "2.0", "1.0"):
        _name = " ".join(["creative commons attribution", *_words.split()])
        NAMES[f"CC-{_kind}-{_version}"] = rf"(?:{_name}|cc {_kind.lower().replace('-', ' ')}) {_version.replace('.', ' ')}"

# Identifiers of the SPDX list that a declaration may use; others are
# reported with LicenseRef- before them.
SPDX = """
0BSD AAL ADSL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AMDPLPA AML APAFML APL-1.0 APSL-1.0 APSL-2.0
Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent
BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1 BitTorrent-1.1 BlueOak-1.0.0 CAL-1.0
CATOSL-1.1 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-2.0 CECILL-2.1
CECILL-B CECILL-C CNRI-Python CPAL-1.0 CPL-1.0 CUA-OPL-1.0 ECL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.0
EUPL-1.1 EUPL-1.2 Elastic-2.0 Entessa FSFAP FTL Fair Frameworx-1.0 GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND
ICU IJG IPA IPL-1.0 ISC ImageMagick Intel JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 LPL-1.0 LPL-1.02 LPPL-1.3c Libpng LiLiQ-P-1.1
MIT MIT-0 MIT-CMU MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MirOS Motosoto MulanPSL-2.0 Multics NASA-1.3 NCSA NGPL NPL-1.0
NPL-1.1 NPOSL-3.0 NTP Naumen Nokia OCLC-2.0 ODC-By-1.0 ODbL-1.0 OFL-1.0 OFL-1.1 OGL-UK-3.0 OLDAP-2.8 OSET-PL-2.1 OSL-1.0
OSL-2.1 OSL-3.0 OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.1 RPL-1.5 RPSL-1.0 RSCPL Ruby
SISSL SMLNJ SPL-1.0 SSPL-1.0 SimPL-2.0 Sleepycat TCL UPL-1.0 Unicode-3.0 Unlicense VSL-1.0 Vim W3C WTFPL Watcom-1.0 X11
XFree86-1.1 Xnet ZPL-2.0 ZPL-2.1 Zend-2.0 Zlib bzip2-1.0.6 curl libtiff zlib-acknowledgement
""".split()

# Sentences of license texts, normalised, by identifier. Of two parts the
# second comes anywhere after the first, up to the full stop.
SENTENCES = {
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy",
    "mit-notice": r"the above copyright notice and this permission notice shall be included",
    "as-is": r"the software is provided as is",
    "bsd-grant": r"redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-source": r"redistributions of source code must retain the above copyright notice",
    "bsd-binary": r"redistributions in binary form must reproduce the above copyright notice",
    "bsd-names": (r"neither the name of", r"may be used to endorse or promote products"),
    "bsd-as-is": (r"this software is provided by", r"as is"),
    "isc-grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee",
    "apache-comply": r"you may not use this file except in compliance with the license",
    "apache-basis": r"software distributed under the license is distributed on an as is basis",
    "mpl2-form": r"subject to the terms of the mozilla public license v 2 0",
    "unlicense-free": r"this is free and unencumbered software released into the public domain",
    "reserved": r"all rights reserved",
    "copyright": r"copyright (?:c )?[12][0-9]{3}",
}

# The notice of the GNU licenses, whose kind and first version name the license.
_GNU = re.compile(r"\bredistribute it and or modify it under the terms of the gnu (library |lesser |affero |)general public license\b")
_VERSION = re.compile(r"\bversion ([0-9](?: [0-9])?)\b")
GNU_GRANTS = {
    ("", "2"): "gpl2-grant", ("", "3"): "gpl3-grant", ("library ", "2"): "lgpl2-grant", ("lesser ", "2 1"): "lgpl21-grant",
    ("lesser ", "3"): "lgpl3-grant", ("affero ", "3"): "agpl3-grant",
}

# Licenses by the sequence of their sentences, the longer ones first.
# A license's name, in a sentence that grants or declares it, is a rule of its own.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("Apache-2.0", ("name:Apache-2.0", "apache-comply", "apache-basis")),
    ("Apache-2.0", ("apache-comply", "apache-basis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL-2.0", ("gpl2-grant",)),
    ("GPL-3.0", ("gpl3-grant",)),
    ("LGPL-2.0", ("lgpl2-grant",)),
    ("LGPL-2.1", ("lgpl21-grant",)),
    ("LGPL-3.0", ("lgpl3-grant",)),
    ("AGPL-3.0", ("agpl3-grant",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("Unlicense", ("unlicense-free",)),
    ("LicenseRef-all-rights-reserved", ("copyright", "reserved")),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
)
RULES_FROM: dict[str, list] = {}
for _license, _rule in RULES:
    RULES_FROM.setdefault(_rule[0], []).append((_license, _rule))
# a sentence that begins a license of its own ends the search for more of the one before
_BEGINS = {rule[0] for _, rule in RULES if not rule[0].startswith("name:")} - {"copyright", "reserved"}

_GRANT = r"(?:licensed|released|distributed|available|provided|published|covered)(?: \w+){0,3} under (?:an? |the )?(?:terms of the )?"
_DECLARED = r"\blicen[sc]es? "
_LEAD = re.compile(rf"{_GRANT}|{_DECLARED}")
_NAME = {name: re.compile(rf"(?:{pattern})(?: only| or later)?\b") for name, pattern in NAMES.items()}
# between two names of a list, and before its first
_GAP = re.compile(
    r"(?: with (?:\w+ ){1,4}?exceptions?(?: [0-9] [0-9])?)?(?: (?:only|or|later|and|any|version|licen[sc]es?|either|both|under|the|an?|terms|of|at|your|option))* "
)
_EITHER = re.compile(r"(?:(?:either|both|of|an?|the|terms) )*")
# an SPDX expression: to the end of its line, or on after an operator there
_SPDX = re.compile(r"spdx-license-identifier:?[ \t]*([^\n]*(?:\b(?:or|and|with)[ \t]*\n[^\n]*)*)", re.IGNORECASE)
_SPDX_PART = re.compile(r"[\s()]*(?:\b(or|and|with)\b|([A-Za-z0-9][A-Za-z0-9.+-]*))[\s()]*", re.IGNORECASE)
_SPDX_NAMES = {name.lower(): name for name in [*SPDX, *NAMES]}
_COLON = re.compile(r"licen[sc]es?[\"']?\s*[:=]", re.IGNORECASE)
_KNOWN = {
    name: tuple(re.compile(rf"\b(?:{part})\b") for part in ([parts] if isinstance(parts, str) else parts))
    for name, parts in SENTENCES.items()
}
# a word of every rule's sentence
_LIKELY = re.compile(
    r"licen[sc]|rights\s+reserved|permission|redistribut|copyright|unencumbered|provided|\bunder\b|neither", re.IGNORECASE
)
_BREAK = re.compile(r"[.!?;](?=\s|$)|\n")
_NOT_WORD = re.compile(r"[^a-z0-9]+")

SPAN = T.StructType().add("license", "string").add("start", "long").add("end", "long")
_ARROW_SPANS = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Where the sentences are; a full stop ends one before a space only."""
    start = 0
    for m in _BREAK.finditer(text):
        if m.start() > start:
            yield start, m.start()
        start = m.end()
    if start < len(text):
        yield start, len(text)


def _blocks(text: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(number of the first piece, pieces) of what goes on over lines and semicolons to a full stop."""
    held: list[tuple[int, int]] = []
    first = 0
    for n, (start, end) in enumerate(sentences(text)):
        held.append((start, end))
        if end >= len(text) or text[end] not in "\n;":
            yield first, held
            held, first = [], n + 1
    if held:
        yield first, held


def _name_at(whole: str, at: int, ends: list[int]) -> tuple[str, int] | None:
    """The license whose name is at a place, and the name's end, in the line if it fits."""
    line = ends[min(bisect_left(ends, at + 1), len(ends) - 1)]
    return next(((name, m.end()) for name, p in _NAME.items() if (m := p.match(whole, at, line) or p.match(whole, at))), None)


def _names(whole: str, ends: list[int], declares: Callable[[int, bool], bool]) -> Iterator[tuple[int, str, int]]:
    """(place, license, end) of the names that grants and declarations give.

    ``ends`` has the end of each line. A list goes on in the next line after "and" or
    "or" or a comma's place within a line. The word "license" declares what follows
    it where ``declares`` says so of its line and whether it begins the line.
    """
    for lead in _LEAD.finditer(whole):
        if lead.group().startswith("licen") and not lead.group().startswith("licensed"):
            line = bisect_right(ends, lead.start())
            begins = lead.start() == (ends[line - 1] + 1 if line and ends[line - 1] else 0)
            if not declares(line, begins):
                continue
        at = _EITHER.match(whole, lead.end()).end()
        while found := _name_at(whole, at, ends):
            yield at, *found
            gap = _GAP.match(whole, found[1])
            if gap is None or re.search(r"licen[sc]es? $", gap.group()):  # a declaration of its own
                break
            wraps = bisect_left(ends, found[1]) != bisect_left(ends, gap.end() + 1)
            if wraps and not re.search(r" (?:and|or) ", gap.group()):
                break
            at = gap.end()


def _sentences_in(whole: str) -> Iterator[tuple[int, str, int]]:
    """(place, identifier, end) of the known sentences, each wherever it is."""
    for name, (first, *rest) in _KNOWN.items():
        last = None
        for m in first.finditer(whole):
            if rest and (last is None or last.start() < m.end()):
                last = rest[0].search(whole, m.end())
                if last is None:
                    break
            yield m.start(), name, (last or m).end()
    version = None
    for m in _GNU.finditer(whole):
        if version is None or version.start() < m.end():
            version = _VERSION.search(whole, m.end())
            if version is None:
                break
        if grant := GNU_GRANTS.get((m.group(1), version.group(1))):
            yield m.start(), grant, version.end()


def declared(text: str) -> Iterator[tuple[int, str, int]]:
    """(place, license, end) of the identifiers in SPDX declarations.

    An identifier goes without -only, -or-later and +; what WITH adds is no license.
    One that is not known has LicenseRef- before it.
    """
    for m in _SPDX.finditer(text):
        at, wanted, skip = m.start(1), True, False
        while part := _SPDX_PART.match(text, at, m.end(1)):
            operator, name = part.groups()
            if bool(operator) == wanted:
                break  # the expression is over
            if operator:
                skip = operator.lower() == "with"
            elif not skip:
                plain = re.sub(r"(?:-only|-or-later|\+)$", "", name)
                yield part.start(2), _SPDX_NAMES.get(plain.lower(), f"LicenseRef-{plain.removeprefix('LicenseRef-')}"), part.end(2)
            wanted, at = not wanted, part.end()


def identifiers(text: str) -> list[tuple[int, str, int, int]]:
    """(number of the sentence, identifier, start, end) of the sentences that are known.

    License texts wrap their lines, so a line without a full stop goes on in the
    next one, and notices join sentences by semicolons. A line gives each identifier
    once, in the order of the text; all that begin in one line have its start, and
    the end of the line that they end in.
    """
    out = []
    likely = [m.start() for m in _LIKELY.finditer(text)]
    marked = list(declared(text))
    for first, pieces in _blocks(text):
        at = bisect_left(likely, pieces[0][0])
        if at == len(likely):
            break
        if likely[at] >= pieces[-1][1]:
            continue
        lines = [_NOT_WORD.sub(" ", text[a:b].lower()).strip() for a, b in pieces]
        whole = " ".join(filter(None, lines))
        ends, total = [], -1
        for line in lines:
            total += len(line) + 1 if line else 0
            ends.append(max(total, 0))
        colons = [bool(_COLON.search(text, a, b)) for a, b in pieces]
        found = [(p, f"name:{k}", to) for p, k, to in _names(whole, ends, lambda line, begins: begins or colons[line])]
        placed = [
            (bisect_right(ends, p), p, k, min(bisect_left(ends, to), len(ends) - 1)) for p, k, to in [*found, *_sentences_in(whole)]
        ]
        starts = [a for a, _ in pieces]
        while marked and marked[0][0] < pieces[-1][1]:
            p, k, to = marked.pop(0)
            line = bisect_right(starts, p) - 1
            if line >= 0:
                placed.append((line, p - starts[line], f"name:{k}", bisect_right(starts, to - 1) - 1))
        seen = set()
        for line, _, name, to in sorted(placed):
            if (line, name) not in seen:
                seen.add((line, name))
                out.append((first + line, name, pieces[line][0], pieces[to][1]))
    return out


def find_licenses(text: str) -> list[dict]:
    """Licenses of one text in order: at each known sentence the first rule that fits."""
    if not _LIKELY.search(text):
        return []
    known = identifiers(text)
    found, used = [], set()
    for at in range(len(known)):
        if at in used:
            continue
        name = known[at][1]
        rules = [*RULES_FROM.get(name, ()), *([(name.removeprefix("name:"), (name,))] if name.startswith("name:") else [])]
        for license_id, rule in rules:
            picked = _match(known, at, rule)
            if picked is not None:
                found.append({"license": license_id, "start": known[at][2], "end": known[picked[-1]][3]})
                # of what lies between only other names count
                used.update(i for i in range(at, picked[-1] + 1) if i in picked or not known[i][1].startswith("name:"))
                break
    return found


def _match(known: list[tuple[int, str, int, int]], at: int, rule: tuple[str, ...]) -> list[int] | None:
    """The places of the rule's sentences if they follow each other from ``at``.

    Anything may lie between them but a sentence that begins a license.
    """
    picked = [at]
    for wanted in rule[1:]:
        at += 1
        while at < len(known) and known[at][1] != wanted:
            if known[at][1] in _BEGINS:
                return None
            at += 1
        if at == len(known):
            return None
        picked.append(at)
    return picked


def scan_licenses(
    docs: DataFrame, text: str = "text", spans_name: str = "licenses", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``licenses``, an array of (license, start, end) in the order of the text.

    Positions count code points, the end exclusive. Sentences are compared without
    case, punctuation and line breaks, and may be as long and as far apart as they are:
    a rule's sentences go together unless another license begins between them. NULL texts are empty and give an empty list;
    texts are scanned in whole. Other columns stay (``keep`` names them, all by
    default), one with the result's name is replaced. Repeated rows each give a row,
    and an empty table gives no rows.
    """
    added = T.StructType().add(spans_name, T.ArrayType(SPAN))

    def compute(texts: list[str]) -> list[pa.Array]:
        return [pa.array([find_licenses(t) for t in texts], type=_ARROW_SPANS)]

    return with_text_columns(docs, whole_text(F.col(f"`{text}`")), compute, added, keep)
