"""License detection by ordered signature rules.

Texts are folded to words (A-Z lower-cased, everything but letters, digits and non-ASCII separates).
Rules are word regexes: signatures written out by hand for the wording of licenses, notices, deeds and addresses, and
rules generated from families of license names and the phrasings around them. A rule is tried only where a part that
each of its matches has occurs. Detections are resolved by priority: one whose interval lies
within the interval of a detection of the same or higher rank is suppressed.

Null and empty texts have no words and no labels; ids and further columns pass through untouched, so
null or repeated ids are no special case; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table
from .texts import fold_words

#: Fixed phrases and their labels; they are never suppressed.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# (label, keywords, name as a word regex, rank). Every match of the name has one of the keywords (parted by |), blanks
# included: a name stands between blanks, but may run on within a word (gplv3). More specific names rank higher (lower number).
FAMILIES = (
    ("mit", " mit ", r"mit", 3),
    ("mit-0", " mit ", r"mit (?:no attribution|0)", 2),
    ("x11", "x11", r"x11", 3),
    ("isc", " isc ", r"isc", 3),
    ("apache-1.1", "apache", r"apache (?:software )?(?:license )?(?:version )?1 1", 2),
    ("apache-2", "apache", r"apache (?:software )?(?:license )?(?:version |v )?2(?: 0)?", 2),
    ("apache", "apache", r"apache(?: software)?", 4),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", 2),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", 2),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)", 2),
    ("bsd", "bsd", r"bsd", 4),
    ("agpl-3", "affero", r"(?:gnu )?affero general public(?: license)? (?:version |v )?3(?: 0)?", 1),
    ("agpl", "affero", r"(?:gnu )?affero general public", 2),
    ("agpl-3", "agpl", r"agpl ?v? ?3(?: 0)?", 2),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public(?: license)? (?:version |v )?2 1", 1),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public(?: license)? (?:version |v )?3(?: 0)?", 1),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public", 2),
    ("lgpl-2", "library", r"(?:gnu )?library general public(?: license)? (?:version |v )?2(?: 0)?", 1),
    ("lgpl", "lgpl", r"lgpl(?: v?[0-9](?: [0-9])?)?", 3),
    ("gpl-2", "general public", r"(?:gnu )?general public(?: license)? (?:version |v )?2(?: 0)?", 2),
    ("gpl-3", "general public", r"(?:gnu )?general public(?: license)? (?:version |v )?3(?: 0)?", 2),
    ("gpl", "general public", r"gnu general public", 4),
    ("gpl-2", "gpl", r"gpl ?v? ?2(?: 0)?", 3),
    ("gpl-3", "gpl", r"gpl ?v? ?3(?: 0)?", 3),
    ("gpl", "gpl", r"(?:gnu )?gpl", 4),
    ("gfdl", "documentation", r"gnu free documentation", 2),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)? (?:version |v )?1 1", 2),
    ("mpl-2", "mozilla", r"mozilla public(?: license)? (?:version |v )?2(?: 0)?", 2),
    ("mpl", "mozilla", r"mozilla public", 4),
    ("epl-1", "eclipse", r"eclipse public(?: license)? (?:version |v )?1(?: 0)?", 2),
    ("epl-2", "eclipse", r"eclipse public(?: license)? (?:version |v )?2(?: 0)?", 2),
    ("epl", "eclipse", r"eclipse public", 4),
    ("eupl", "european", r"european union public", 2),
    ("cddl", "cddl", r"cddl(?: 1 [01])?", 3),
    ("cddl", "distribution", r"common development and distribution", 2),
    ("cpl", "common public", r"common public", 3),
    ("osl", "open software", r"open software", 4),
    ("afl", "academic", r"academic free", 3),
    ("artistic", "artistic", r"artistic(?: license)?(?: (?:version )?[12] 0)?", 3),
    ("zlib", "zlib", r"zlib(?: libpng)?", 3),
    ("boost", "boost", r"boost software", 3),
    ("postgresql", "postgresql", r"postgresql", 4),
    ("python", "python|psf", r"(?:python software foundation|psf)", 3),
    ("php", " php ", r"php", 4),
    ("ruby", " ruby ", r"ruby", 4),
    ("ofl", "open font", r"(?:sil )?open font", 3),
    ("wtfpl", "wtfpl", r"wtfpl", 3),
    ("unlicense", "unlicense", r"unlicense", 3),
    ("public-domain", "public domain", r"public domain", 4),
    ("cc0", "cc0", r"cc0(?: 1 0)?", 3),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?", 1),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?", 1),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?", 2),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?", 2),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?", 2),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?", 4),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv[a-z]{0,12}", 1),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike", 1),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial", 2),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv[a-z]{0,12}", 2),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike", 2),
    ("cc-by", "creative", r"creative commons attribution", 4),
    ("odbl", "database", r"open (?:data commons open )?database", 3),
    ("proprietary", "proprietary", r"proprietary", 5),
)

# Phrasings around a name, with the confidence they lend.
PHRASINGS = (
    (r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{0}(?: licen[sc]e)?(?: (?:version|v) [0-9](?: [0-9])?)?", 0.95),
    (r"(?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?{0}(?: licen[sc]e)?", 0.9),
    (r"spdx licen[sc]e identifier {0}", 1.0),
    (r"licen[sc]e(?:s|d)? (?:is |type |name |as )?{0}", 0.7),
    (r"(?:the )?{0} licen[sc]e(?: agreement)?(?: (?:version|v) [0-9](?: [0-9])?)?", 0.8),
)

# Signatures of the licenses' own wording: label, keyword, word regex, rank, confidence. Ranks of texts that several licenses
# share lie above (lower priority) those of what only one has.
SIGNATURES = (
    # MIT and its kin
    ("mit", "any person obtaining", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 2, 0.95),
    ("mit", "to deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 2, 0.95),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2, 0.85),
    ("mit", "the software is provided", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 4, 0.6),
    ("mit", "opensource org", r"opensource org licenses mit(?: license)?", 2, 0.9),
    ("mit", "expat", r"expat licen[sc]e", 2, 0.9),
    ("mit-0", "mit 0", r"spdx licen[sc]e identifier mit 0", 0, 1.0),
    ("json", "for good not evil", r"the software shall be used for good not evil", 0, 1.0),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising", 1, 0.95),
    ("x11", "x window system", r"x window system is a trademark of x consortium", 1, 0.9),
    ("hpnd", "fee is hereby granted", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 2, 0.85),
    ("isc", "with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 1, 0.95),
    ("isc", "the author disclaims", r"the software is provided as is and the author disclaims all warranties", 3, 0.8),
    ("isc", "opensource org", r"opensource org licenses isc", 2, 0.9),
    ("0bsd", "0bsd", r"0bsd", 1, 0.9),
    ("0bsd", "zero clause", r"(?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?", 1, 0.95),
    ("curl", "curl", r"curl licen[sc]e", 2, 0.85),
    ("ntp", "ntp", r"ntp licen[sc]e", 2, 0.85),
    ("icu", "unicode inc", r"unicode inc licen[sc]e agreement data files and software", 1, 0.95),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[sc]e", 1, 0.95),
    ("ncsa", "ncsa", r"ncsa open source licen[sc]e", 1, 0.95),
    ("w3c", "w3c", r"w3c software (?:notice|and document) (?:and |notice and )?licen[sc]e", 1, 0.95),
    # BSD
    ("bsd-2-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 3, 0.9),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission", 2, 0.95),
    ("bsd-3-clause", "neither the name", r"neither the name of (?:the )?(?:copyright holder|author|university|regents) nor the names of (?:its|his|their) contributors", 2, 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, 0.95),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 4, 0.8),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", 4, 0.8),
    ("bsd", "this software is provided by", r"this software is provided by the (?:copyright holders?|authors?|regents) and contributors as is", 4, 0.7),
    ("bsd-3-clause-clear", "patent rights are granted", r"no express or implied licen[sc]es to any partys? patent rights are granted by this licen[sc]e", 1, 0.9),
    ("bsd-3-clause", "opensource org", r"opensource org licenses bsd 3 clause", 1, 0.95),
    ("bsd-2-clause", "opensource org", r"opensource org licenses bsd 2 clause", 1, 0.95),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", 0, 0.95),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young", 0, 0.95),
    ("zlib", "express or implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 2, 0.95),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented", 2, 0.9),
    ("libpng", "png reference library", r"the png reference library is supplied as is", 1, 0.95),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 0, 1.0),
    ("beerware", "beer ware", r"the beer ware licen[sc]e", 0, 1.0),
    # Apache
    ("apache-2", "apache org", r"apache org licenses license 2 0(?: txt| html)?", 1, 0.95),
    ("apache-2", "except in compliance", r"you may not use this file except in compliance with the licen[sc]e", 3, 0.8),
    ("apache-2", "january 2004", r"apache licen[sc]e version 2 0 january 2004", 1, 1.0),
    ("apache-2", "limitations under the license", r"see the licen[sc]e for the specific language governing permissions and limitations under the license", 3, 0.8),
    ("apache-2-llvm", "llvm", r"apache 2 0 with llvm exceptions?", 0, 1.0),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 2, 0.85),
    # GNU
    ("gpl", "free software foundation", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation", 3, 0.95),
    ("gpl-2", "either version 2", r"as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version", 1, 0.95),
    ("gpl-3", "either version 3", r"as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", 2, 0.9),
    ("gpl-2-only", "version 2 only", r"gnu general public licen[sc]e version 2 only", 0, 1.0),
    ("gpl-3-only", "version 3 only", r"gnu general public licen[sc]e version 3 only", 0, 1.0),
    ("gpl-2-only", "gpl 2 0 only", r"(?:spdx licen[sc]e identifier )?gpl 2 0 only", 0, 1.0),
    ("gpl-2-or-later", "gpl 2 0 or later", r"(?:spdx licen[sc]e identifier )?gpl 2 0 or later", 0, 1.0),
    ("gpl-3-only", "gpl 3 0 only", r"(?:spdx licen[sc]e identifier )?gpl 3 0 only", 0, 1.0),
    ("gpl-3-or-later", "gpl 3 0 or later", r"(?:spdx licen[sc]e identifier )?gpl 3 0 or later", 0, 1.0),
    ("gpl-2", "june 1991", r"gnu general public licen[sc]e version 2 june 1991", 0, 1.0),
    ("gpl-3", "29 june 2007", r"gnu general public licen[sc]e version 3 29 june 2007", 0, 1.0),
    ("lgpl", "gnu lesser", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation", 1, 0.95),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public licen[sc]e version 2 1 february 1999", 0, 1.0),
    ("lgpl-2", "june 1991", r"gnu library general public licen[sc]e version 2 june 1991", 0, 1.0),
    ("lgpl-3", "29 june 2007", r"gnu lesser general public licen[sc]e version 3 29 june 2007", 0, 1.0),
    ("lgpl-2.1-only", "lgpl 2 1 only", r"(?:spdx licen[sc]e identifier )?lgpl 2 1 only", 0, 1.0),
    ("lgpl-2.1-or-later", "lgpl 2 1 or later", r"(?:spdx licen[sc]e identifier )?lgpl 2 1 or later", 0, 1.0),
    ("lgpl-3-or-later", "lgpl 3 0 or later", r"(?:spdx licen[sc]e identifier )?lgpl 3 0 or later", 0, 1.0),
    ("agpl", "gnu affero", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation", 1, 0.95),
    ("agpl-3", "19 november 2007", r"gnu affero general public licen[sc]e version 3 19 november 2007", 0, 1.0),
    ("agpl-3-only", "agpl 3 0 only", r"(?:spdx licen[sc]e identifier )?agpl 3 0 only", 0, 1.0),
    ("agpl-3-or-later", "agpl 3 0 or later", r"(?:spdx licen[sc]e identifier )?agpl 3 0 or later", 0, 1.0),
    ("gpl", "gnu org licenses", r"gnu org licenses gpl(?: [23] 0)?(?: html| txt)?", 3, 0.85),
    ("lgpl", "gnu org licenses", r"gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?", 3, 0.85),
    ("agpl", "gnu org licenses", r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 3, 0.85),
    ("gpl-classpath", "classpath exception", r"(?:with )?(?:the )?classpath exception(?: 2 0)?", 1, 0.9),
    ("gpl-gcc", "runtime library exception", r"gcc runtime library exception(?: 3 1| 2 0)?", 1, 0.95),
    ("gpl-autoconf", "autoconf exception", r"autoconf exception", 1, 0.9),
    ("gpl-font", "font exception", r"font exception 2 0", 1, 0.9),
    ("linux-syscall", "syscall note", r"linux syscall note", 1, 0.9),
    ("gfdl", "invariant sections", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", 1, 0.95),
    ("gfdl", "gnu free documentation", r"under the terms of the gnu free documentation licen[sc]e", 1, 0.95),
    # Other copyleft
    ("mpl-2", "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 0, 1.0),
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0", 1, 0.95),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 0, 1.0),
    ("epl-1", "eclipse org", r"eclipse org legal epl v10(?: html)?", 1, 0.95),
    ("epl-2", "eclipse org", r"eclipse org legal epl 2 0", 1, 0.95),
    ("epl", "eclipse public", r"made available under the terms of the eclipse public licen[sc]e", 3, 0.9),
    ("cddl", "common development", r"subject to the terms of the common development and distribution licen[sc]e", 1, 0.95),
    ("cpl", "common public", r"made available under the terms of the common public licen[sc]e v1 0", 2, 0.95),
    ("eupl", "eupl", r"eupl(?: v? ?1 [0-2])?", 2, 0.9),
    ("cecill", "cecill", r"cecill(?: (?:b|c|2 [01]))?(?: licen[sc]e)?", 2, 0.9),
    ("osl", "opensource org", r"opensource org licenses osl 3 0", 1, 0.95),
    ("artistic", "standard version", r"the package may be distributed as a standard version", 3, 0.8),
    ("artistic", "same terms as perl", r"under the same terms as perl itself", 1, 0.95),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", 1, 0.95),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", 1, 0.95),
    ("sspl", "server side public", r"server side public licen[sc]e", 1, 0.95),
    ("busl", "business source", r"business source licen[sc]e(?: 1 1)?", 1, 0.95),
    ("elastic", "elastic", r"elastic licen[sc]e(?: 2 0)?", 2, 0.85),
    ("mulan", "mulan", r"mulan (?:permissive software licen[sc]e|psl)(?: v ?[12])?", 1, 0.95),
    ("blueoak", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?", 1, 0.95),
    ("upl", "universal permissive", r"universal permissive licen[sc]e(?: v 1 0)?", 1, 0.95),
    ("vim", "vim", r"vim licen[sc]e", 2, 0.85),
    ("zope", "zope public", r"zope public licen[sc]e", 1, 0.95),
    ("qpl", "q public", r"q public licen[sc]e", 1, 0.95),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", 1, 0.95),
    ("boost", "boost software", r"boost software licen[sc]e version 1 0", 1, 0.95),
    ("boost", "boost org", r"boost org licen[sc]e 1 0 txt", 1, 0.95),
    ("postgresql", "postgresql global", r"postgresql global development group", 3, 0.7),
    ("python", "python software foundation", r"python software foundation licen[sc]e version 2", 1, 0.95),
    ("php", "php net", r"php net license 3 01? txt", 1, 0.95),
    ("ofl", "sil open font", r"this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1", 0, 1.0),
    ("ofl", "scripts sil org", r"scripts sil org ofl", 1, 0.95),
    # Public domain and Creative Commons
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0, 1.0),
    ("unlicense", "unlicense org", r"unlicense org", 2, 0.9),
    ("wtfpl", "do what the", r"do what the fuck you want to public licen[sc]e", 0, 1.0),
    ("cc0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0", 1, 0.95),
    ("cc0", "cc0", r"cc0 (?:1 0 )?(?:universal|no rights reserved)", 1, 0.95),
    ("public-domain", "dedicated to the public", r"dedicated to the public domain", 3, 0.9),
    ("public-domain", "released into the public", r"(?:has been |is )?released into the public domain", 3, 0.9),
    ("public-domain", "placed in the public", r"(?:has been |is )?placed in the public domain", 3, 0.9),
    ("cc-by", "creativecommons org", r"creativecommons org licen[sc]es by [1-4] [05]", 1, 0.95),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licen[sc]es by sa [1-4] [05]", 1, 0.95),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licen[sc]es by nd [1-4] [05]", 1, 0.95),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licen[sc]es by nc [1-4] [05]", 1, 0.95),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licen[sc]es by nc sa [1-4] [05]", 1, 0.95),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licen[sc]es by nc nd [1-4] [05]", 1, 0.95),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl", 1, 0.95),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by", 1, 0.95),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl", 1, 0.95),
    # Restrictive
    ("proprietary", "copying of this file", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", 2, 0.95),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 3, 0.85),
    ("proprietary", "no part of this", r"no part of this (?:publication|document|book|software) may be reproduced", 2, 0.9),
    ("proprietary", "end user", r"end user licen[sc]e agreement", 3, 0.8),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 5, 0.4),
)

#: Names that mean a license even without a phrasing around them.
TELLING = {"affero", "agpl", "lesser", "lgpl", "gpl", "mozilla", "eclipse", "european", "cddl", "distribution", "wtfpl", "unlicense", "cc0", "cc by", "creative", "documentation"}


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    rank: int
    confidence: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, by rank: the signatures, each family in each phrasing, and telling names alone."""
    found = [Rule(label, (keyword.encode(),), re.compile(rf"(?<![^ ]){form}(?![^ ])".encode()), rank, confidence) for label, keyword, form, rank, confidence in SIGNATURES]
    for label, keyword, name, rank in FAMILIES:
        forms = [(p.format(f"(?:{name})"), c) for p, c in PHRASINGS]
        if keyword in TELLING:
            forms.append((f"(?:{name})", 0.6))
        for form, confidence in forms:
            found.append(Rule(label, tuple(keyword.encode().split(b"|")), re.compile(rf"(?<![^ ]){form}(?![^ ])".encode()), rank, confidence))
    return tuple(sorted(found, key=lambda r: (r.rank, -r.confidence)))


@cache
def keywords() -> tuple[tuple[bytes, ...], ...]:
    return tuple({r.keywords: None for r in rules()})


_BASE = tuple((p.encode(), re.compile(rf"(?<![^ ])(?={p}(?![^ ]))".encode()), label, len(p.split())) for p, label in BASE)


def detect(text: bytes, gated: bool = True) -> dict:
    """Words, base places and resolved labels of one text; without gates every rule is tried."""
    words = fold_words(text)
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
    line = b" ".join(words)
    padded = b" " + line + b" "
    present = {k for k in keywords() if not gated or any(part in padded for part in k)}
    if not present:  # each base phrase has a keyword too
        return out
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    place = lambda x: bisect_right(starts, x) - 1
    base = [(place(m.start()), n, label) for phrase, pattern, label, n in _BASE if phrase in line for m in pattern.finditer(line)]
    kept = [(a, a + n, 0, 1.0, label) for a, n, label in base]
    found = []
    for r in rules():
        if r.keywords in present:
            for m in r.pattern.finditer(line):
                found.append((r.rank, -(m.end() - m.start()), m.start(), m.end(), r.confidence, r.label))
    taken: list[tuple[int, int]] = []
    for _, _, a, b, confidence, label in sorted(found):
        if not any(x <= a and b <= y for x, y in _near(taken, a)):
            _put(taken, (a, b))
            kept.append((place(a), place(b - 1) + 1, 1, confidence, label))
    at = [a for a, _, _ in base]
    return out | {
        "n_base": len(base),
        "first_word": min(at, default=None),
        "last_word": max(at, default=None),
        "base_labels": ",".join(sorted({label for _, _, label in base})),
        "labels": ",".join(sorted({k[4] for k in kept})),
        "score": max((k[3] for k in kept), default=0.0),
    }


#: No detection is longer than this many bytes of folded words.
LONGEST = 400


def _put(taken: list[tuple[int, int]], span: tuple[int, int]) -> None:
    taken.insert(bisect_right(taken, span), span)


def _near(taken: list[tuple[int, int]], a: int) -> list[tuple[int, int]]:
    """Spans kept so far that may contain one that begins at ``a``."""
    return taken[bisect_right(taken, (a - LONGEST, 0)) : bisect_right(taken, (a, 1 << 62))]


FIELDS = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and the fields of ``detect``. No shuffle."""
    narrow = docs.select(F.col(id_col), F.col(text_col))
    schema = T.StructType([narrow.schema[0], *(T.StructField(n, T._parse_datatype_string(t)) for n, t in FIELDS)])
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [detect((t or "").encode()) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[n] for r in rows], kinds[t]) for n, t in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *(n for n, _ in FIELDS)])

    return narrow.mapInArrow(run, schema)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scans": op4_license_scans}
ORACLE: dict = {}
