"""License scan: ordered signature rules behind a keyword prefilter.

Base phrases are counted on words. On top, ordered rules look for signatures:
hand-written sentences of notices, conditions and disclaimers, then names of
licenses in sentence forms with and without versions, then identifiers, then
links. A rule runs only where one of the literals that its pattern requires
occurs; these literals are read off the pattern itself, so that a gate can't
miss what its rule matches, and one automaton finds all of them in a pass.
White space of any length, and comment marks at the start of a line, may stand
between words. Detections that overlap are resolved: an interval contained in
another goes, of equal intervals the earlier rule stays.

Defined cases: null and empty texts have no words, no labels and score 0. Rows
are scanned one by one, repeated ones too. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import re._constants as code
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.kernels import ALNUM, Words, byte_lengths, chunks

#: The base phrases and their labels, in listed order.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

#: Between words: white space, and after a line break comment marks too.
_BREAK = r"(?:[\n\x0b-\r][ \t]*(?:(?:[*#;%>|!/]+|--+)[ \t]*)?)"
GAP = rf"(?:[ \t]+{_BREAK}*|{_BREAK}+)"

#: Sentences of notices, conditions and disclaimers: label, weight, pattern. A blank stands for GAP. Earlier ones have priority.
SIGNATURES = (
    ("mit", 0.95, r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 0.9, r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"),
    ("mit", 0.85, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", 0.95, r"mit no attribution"),
    ("x11", 0.9, r"except as contained in this notice, the names? of the (?:x consortium|above copyright holders?) shall not be used in advertising"),
    ("bsd-3-clause", 0.9, r"neither the names? of (?:the )?[^\n.]{1,60}? nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 0.85, r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", 0.8, r"redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd", 0.8, r"redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd", 0.7, r"this software is provided by (?:the )?[^\n.]{1,60}? ['\"“‘`]*as is['\"”’`]* and any express or implied warranties"),
    ("0bsd", 0.9, r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\."),
    ("isc", 0.9, r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that"),
    ("isc", 0.7, r"the author disclaims all warranties with regard to this software"),
    ("hpnd", 0.85, r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose"),
    ("apache", 0.95, r"licensed under the apache license, version 2\.0 \(the ['\"“‘]license['\"”’]\)"),
    ("apache", 0.9, r"you may not use this file except in compliance with the license"),
    ("apache", 0.8, r"unless required by applicable law or agreed to in writing, software distributed under the license"),
    ("apache", 0.9, r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache", 0.85, r"this product includes software developed (?:at|by) the apache (?:software foundation|group)"),
    ("gpl", 0.95, r"is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", 0.95, r"is free software[:;] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("agpl", 0.95, r"is free software[:;] you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", 0.8, r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license"),
    ("lgpl", 0.8, r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu (?:lesser|library) general public license"),
    ("agpl", 0.8, r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu affero general public license"),
    ("gpl", 0.8, r"you should have received a copy of the gnu general public license"),
    ("lgpl", 0.8, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", 0.8, r"you should have received a copy of the gnu affero general public license"),
    ("gpl", 0.7, r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl-exception", 0.85, r"as a special exception, (?:the copyright holders? of this library give|if you link this library with other files)"),
    ("gpl-exception", 0.85, r"classpath exception"),
    ("gfdl", 0.9, r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 0.75, r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("mpl", 0.95, r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", 0.85, r"the contents of this file are subject to the mozilla public license"),
    ("mpl", 0.8, r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("epl", 0.95, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 0.85, r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cddl", 0.95, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", 0.9, r"the accompanying program is provided under the terms of this common public license"),
    ("ipl", 0.9, r"ibm public license"),
    ("eupl", 0.95, r"licensed under the eupl"),
    ("artistic", 0.9, r"you may (?:redistribute it and/or modify it|distribute it) under the same terms as perl(?: itself)?"),
    ("artistic", 0.85, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("boost", 0.95, r"distributed under the boost software license, version 1\.0"),
    ("boost", 0.9, r"to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software"),
    ("zlib", 0.9, r"this software is provided ['\"“‘`]*as-is['\"”’`]*, without any express or implied warranty\. in no event will the authors be held liable"),
    ("zlib", 0.85, r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib", 0.8, r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("unlicense", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 0.85, r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", 0.9, r"you just do what the f\S{1,6} you want to"),
    ("beerware", 0.95, r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("ofl", 0.95, r"this font software is licensed under the sil open font license"),
    ("ofl", 0.85, r"reserved font name"),
    ("psf", 0.85, r"psf is making python available to licensee on an ['\"“‘`]*as is['\"”’`]* basis"),
    ("openssl", 0.9, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 0.85, r"this product includes cryptographic software written by eric young"),
    ("postgresql", 0.9, r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    ("ncsa", 0.9, r"to deal with the software without restriction, including without limitation the rights to use"),
    ("w3c", 0.85, r"w3c software (?:and document )?(?:notice and )?license"),
    ("json", 0.9, r"the software shall be used for good, not evil"),
    ("vim", 0.85, r"vim is charityware"),
    ("sleepycat", 0.85, r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("qpl", 0.85, r"q public license"),
    ("lppl", 0.9, r"this work may be distributed and/or modified under the conditions of the latex project public license"),
    ("sspl", 0.85, r"offering the functionality of the program (?:or modified version )?to third parties as a service"),
    ("busl", 0.85, r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use"),
    ("elastic", 0.9, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 0.9, r"the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software"),
    ("polyform", 0.9, r"polyform (?:noncommercial|small business|free trial|internal use|perimeter|shield|strict)"),
    ("openrail", 0.9, r"(?:creativeml |bigscience |bigcode )?open ?rail(?:\+\+)?-?m(?: license)?"),
    ("llama", 0.9, r"llama (?:[0-9.]+ )?community license(?: agreement)?"),
    ("cc0", 0.95, r"to the extent possible under law, [^\n]{1,80}? has waived all copyright and related or neighboring rights"),
    ("cc0", 0.9, r"no rights reserved"),
    ("cc-by", 0.8, r"you are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit"),
    ("cc-by-nc", 0.8, r"you may not use the material for commercial purposes"),
    ("cc-by-nd", 0.8, r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("cc-by-sa", 0.8, r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license"),
    ("odbl", 0.9, r"this database is made available under the open database license"),
    ("odbl", 0.85, r"any rights in individual contents of the database are licensed under the database contents license"),
    ("odc-by", 0.9, r"open data commons attribution license"),
    ("pddl", 0.9, r"(?:open data commons )?public domain dedication and license"),
    ("ogl", 0.9, r"contains public sector information licensed under the open government licen[cs]e"),
    ("ogl", 0.8, r"open government licen[cs]e"),
    ("etalab", 0.85, r"licence ouverte(?: / open licence)?"),
    ("dl-de", 0.85, r"datenlizenz deutschland"),
    ("gutenberg", 0.9, r"this e(?:book|text) is for the use of anyone anywhere (?:in the united states and most other parts of the world )?at no cost"),
    ("gutenberg", 0.8, r"project gutenberg(?:-tm|™)? license"),
    ("public-domain", 0.9, r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", 0.85, r"this work is in the public domain"),
    ("public-domain", 0.85, r"the authors? (?:hereby )?disclaims? (?:all )?copyright to this (?:source code|work)"),
    ("proprietary", 0.85, r"this (?:software|document|material|file|source code) is (?:the )?(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 0.85, r"unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or distribution)? of this (?:file|software|document|material|work)[^\n.]{0,60}? is strictly prohibited"),
    ("proprietary", 0.85, r"no part of this (?:publication|book|document|work|site) may be (?:reproduced|copied)"),
    ("proprietary", 0.8, r"(?:may not|must not|cannot) be (?:reproduced|copied|redistributed|republished)[^\n.]{0,60}? without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)"),
    ("proprietary", 0.75, r"without (?:the )?(?:prior|express) written (?:permission|consent) of the (?:publisher|author|copyright (?:owner|holder))"),
    ("proprietary", 0.8, r"for (?:internal|personal|evaluation|non-?commercial) use only"),
    ("warranty", 0.6, r"the software is provided ['\"“‘`]*as is['\"”’`]*, without warranty of any kind"),
    ("warranty", 0.6, r"in no event shall the (?:authors?|copyright holders?|copyright owners?|regents)[^\n.]{0,60}? be liable for any"),
    ("dual", 0.7, r"(?:dual|multi|tri)-?licen[cs]ed under"),
    ("dual", 0.6, r"at your option, any later version"),
)

#: label: name, versions, stems of identifiers, link.
FAMILIES = {
    "agpl": (r"gnu affero general public licen[cs]e", ("3", "1"), ("agpl",), "gnu.org/licenses/agpl"),
    "lgpl": (r"gnu (?:lesser|library) general public licen[cs]e", ("3", "2.1", "2"), ("lgpl",), "gnu.org/licenses/lgpl"),
    "gpl": (r"gnu general public licen[cs]e", ("3", "2", "1"), ("gpl",), "gnu.org/licenses/gpl"),
    "gfdl": (r"gnu free documentation licen[cs]e", ("1.3", "1.2", "1.1"), ("gfdl", "fdl"), "gnu.org/licenses/fdl"),
    "apache": (r"apache (?:software )?licen[cs]e", ("2.0", "1.1", "1.0"), ("apache",), "apache.org/licenses"),
    "mit": (r"mit licen[cs]e", (), ("mit",), "opensource.org/licenses/mit"),
    "bsd": (r"(?:new |simplified |modified |revised |original )?bsd licen[cs]e", (), ("bsd",), "opensource.org/licenses/bsd"),
    "mpl": (r"mozilla public licen[cs]e", ("2.0", "1.1", "1.0"), ("mpl",), "mozilla.org/mpl"),
    "epl": (r"eclipse public licen[cs]e", ("2.0", "1.0"), ("epl",), "eclipse.org/legal/epl"),
    "cddl": (r"common development and distribution licen[cs]e", ("1.1", "1.0"), ("cddl",), "opensource.org/licenses/cddl"),
    "cpl": (r"common public licen[cs]e", ("1.0",), ("cpl",), "opensource.org/licenses/cpl"),
    "eupl": (r"european union public licen[cs]e", ("1.2", "1.1"), ("eupl",), "eupl.eu"),
    "artistic": (r"(?:perl )?artistic licen[cs]e", ("2.0", "1.0"), ("artistic",), "opensource.org/licenses/artistic"),
    "boost": (r"boost software licen[cs]e", ("1.0",), ("bsl",), "boost.org/license"),
    "isc": (r"isc licen[cs]e", (), ("isc",), "opensource.org/licenses/isc"),
    "zlib": (r"zlib(?:/libpng)? licen[cs]e", (), ("zlib",), "opensource.org/licenses/zlib"),
    "unlicense": (r"the unlicen[cs]e", (), ("unlicense",), "unlicense.org"),
    "wtfpl": (r"do what the f\S+ you want to public licen[cs]e", ("2", "1"), ("wtfpl",), "wtfpl.net"),
    "osl": (r"open software licen[cs]e", ("3.0", "2.1"), ("osl",), "opensource.org/licenses/osl"),
    "afl": (r"academic free licen[cs]e", ("3.0", "2.1"), ("afl",), "opensource.org/licenses/afl"),
    "ecl": (r"educational community licen[cs]e", ("2.0", "1.0"), ("ecl",), "opensource.org/licenses/ecl"),
    "ofl": (r"sil open font licen[cs]e", ("1.1", "1.0"), ("ofl",), "scripts.sil.org/ofl"),
    "psf": (r"python software foundation licen[cs]e", ("2",), ("psf", "python"), "python.org/psf/license"),
    "php": (r"php licen[cs]e", ("3.01", "3.0"), ("php",), "php.net/license"),
    "ruby": (r"ruby licen[cs]e", (), ("ruby",), "ruby-lang.org/en/about/license"),
    "upl": (r"universal permissive licen[cs]e", ("1.0",), ("upl",), "opensource.org/licenses/upl"),
    "lppl": (r"latex project public licen[cs]e", ("1.3c", "1.3", "1.2"), ("lppl",), "latex-project.org/lppl"),
    "postgresql": (r"postgresql licen[cs]e", (), ("postgresql",), "postgresql.org/about/licence"),
    "openssl": (r"openssl licen[cs]e", (), ("openssl",), "openssl.org/source/license"),
    "ncsa": (r"university of illinois/ncsa open source licen[cs]e", (), ("ncsa",), "opensource.org/licenses/ncsa"),
    "mulan": (r"mulan (?:permissive software|psl) ?(?:licen[cs]e)?", ("2", "1"), ("mulanpsl",), "license.coscl.org.cn/mulanpsl"),
    "blueoak": (r"blue oak model licen[cs]e", ("1.0.0",), ("blueoak",), "blueoakcouncil.org/license"),
    "cecill": (r"cecill(?:-[bc])? (?:free software )?licen[cs]e", ("2.1", "2"), ("cecill",), "cecill.info"),
    "zpl": (r"zope public licen[cs]e", ("2.1", "2.0"), ("zpl",), "zope.org/resources/zpl"),
    "ms-pl": (r"microsoft public licen[cs]e", (), ("ms-pl",), "opensource.org/licenses/ms-pl"),
    "ms-rl": (r"microsoft reciprocal licen[cs]e", (), ("ms-rl",), "opensource.org/licenses/ms-rl"),
    "sspl": (r"server side public licen[cs]e", ("1",), ("sspl",), "mongodb.com/licensing/server-side-public-license"),
    "busl": (r"business source licen[cs]e", ("1.1",), ("busl",), "mariadb.com/bsl"),
    "elastic": (r"elastic licen[cs]e", ("2.0",), ("elastic",), "elastic.co/licensing"),
    "odbl": (r"open (?:data commons )?database licen[cs]e", ("1.0",), ("odbl",), "opendatacommons.org/licenses/odbl"),
    "cc0": (r"(?:cc0|creative commons zero)", ("1.0",), ("cc0",), "creativecommons.org/publicdomain/zero"),
    "cc-by-nc-nd": (r"(?:cc(?: |-)by-nc-nd|creative commons attribution-?non-?commercial-no-?deriv\w*)", ("4.0", "3.0", "2.5", "2.0"), ("cc-by-nc-nd",), "creativecommons.org/licenses/by-nc-nd"),
    "cc-by-nc-sa": (r"(?:cc(?: |-)by-nc-sa|creative commons attribution-?non-?commercial-share-?alike)", ("4.0", "3.0", "2.5", "2.0"), ("cc-by-nc-sa",), "creativecommons.org/licenses/by-nc-sa"),
    "cc-by-nc": (r"(?:cc(?: |-)by-nc|creative commons attribution-?non-?commercial)", ("4.0", "3.0", "2.5", "2.0"), ("cc-by-nc",), "creativecommons.org/licenses/by-nc"),
    "cc-by-nd": (r"(?:cc(?: |-)by-nd|creative commons attribution-no-?deriv\w*)", ("4.0", "3.0", "2.5", "2.0"), ("cc-by-nd",), "creativecommons.org/licenses/by-nd"),
    "cc-by-sa": (r"(?:cc(?: |-)by-sa|creative commons attribution-share-?alike)", ("4.0", "3.0", "2.5", "2.0"), ("cc-by-sa",), "creativecommons.org/licenses/by-sa"),
    "cc-by": (r"(?:cc(?: |-)by|creative commons attribution)", ("4.0", "3.0", "2.5", "2.0"), ("cc-by",), "creativecommons.org/licenses/by"),
    "public-domain": (r"public domain", (), (), "creativecommons.org/licenses/publicdomain"),
    "proprietary": (r"all rights reserved", (), ("licenseref-proprietary",), None),
}
#: Sentence forms around a name, the most telling first, with the weight of a detection.
FORMS = (
    (r"(?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{name}", 0.9),
    (r"(?:subject to|governed by|covered by|use of this \w+ is governed by) (?:the )?(?:terms of )?(?:the )?{name}", 0.85),
    (r"{name}", 0.6),
)
#: Short identifiers in running text: label, weight, pattern.
IDENTIFIERS = (
    ("bsd-2-clause", 0.85, r"(?:bsd[- ]2[- ]clause|2[- ]clause bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", 0.85, r"(?:bsd[- ]3[- ]clause|3[- ]clause bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", 0.85, r"(?:bsd[- ]4[- ]clause|4[- ]clause bsd)(?: licen[cs]e)?"),
    ("0bsd", 0.85, r"0bsd|zero-clause bsd"),
    ("mit-0", 0.85, r"mit-0"),
    ("apache", 0.85, r"(?:apache|asl)[- ]?v?2\.0"),
    ("agpl", 0.85, r"agpl[- ]?v?[13](?:\.0)?(?:\+|-only|-or-later)?"),
    ("lgpl", 0.85, r"lgpl[- ]?v?(?:2\.1|[23](?:\.0)?)(?:\+|-only|-or-later)?"),
    ("gpl", 0.85, r"gpl[- ]?v?[123](?:\.0)?(?:\+|-only|-or-later)?"),
    ("gpl", 0.6, r"gnu gpl"),
    ("lgpl", 0.6, r"gnu lgpl"),
    ("mpl", 0.8, r"mpl[- ]?v?(?:1\.1|2\.0)"),
    ("epl", 0.8, r"epl[- ]?v?[12]\.0"),
    ("cddl", 0.8, r"cddl[- ]?v?1\.[01]"),
    ("eupl", 0.8, r"eupl[- ]?v?1\.[12]"),
    ("artistic", 0.8, r"artistic[- ][12]\.0"),
    ("boost", 0.8, r"bsl-1\.0"),
    ("ofl", 0.8, r"ofl[- ]1\.1"),
    ("afl", 0.8, r"afl[- ]?v?[23]\.[01]"),
    ("ecl", 0.8, r"ecl-2\.0"),
    ("osl", 0.8, r"osl-[23]\.[01]"),
    ("odbl", 0.8, r"odbl(?:[- ]1\.0)?"),
    ("gfdl", 0.8, r"gfdl(?:[- ]1\.[123])?"),
    ("sspl", 0.8, r"sspl(?:[- ]1(?:\.0)?)?"),
    ("busl", 0.8, r"busl-1\.1"),
    ("wtfpl", 0.8, r"wtfpl"),
    ("lppl", 0.8, r"lppl(?:[- ]1\.[0-9]c?)?"),
    ("unlicense", 0.8, r"unlicense"),
    ("ms-pl", 0.8, r"ms-pl"),
    ("ms-rl", 0.8, r"ms-rl"),
    ("cecill", 0.8, r"cecill(?:-[bc])?"),
    ("mulan", 0.8, r"mulanpsl-[12]\.0"),
    ("beerware", 0.8, r"beer-?ware(?: licen[cs]e)?"),
)


@dataclass(frozen=True)
class Rule:
    """A signature: whichever text it matches holds a literal of each group of `gate`, the most telling group first."""

    label: str
    weight: float
    pattern: re.Pattern
    gate: tuple[tuple[str, ...], ...]


def required_literals(pattern: str, least: int = 4) -> tuple[tuple[str, ...], ...]:
    """Groups of literals; every match of the pattern holds at least one of each group.

    The group whose shortest literal is longest comes first, then those without literals below `least` characters.
    """

    def options(items) -> list[frozenset]:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is code.LITERAL:
                run += chr(arg)
                continue
            if run:
                found.append(frozenset([run]))
                run = ""
            if op is code.SUBPATTERN:
                found += options(arg[3])
            elif op in (code.MAX_REPEAT, code.MIN_REPEAT) and arg[0]:
                found += options(arg[2])
            elif op is code.BRANCH and all(each := [best(options(x)) for x in arg[1]]):
                found.append(frozenset().union(*each))
        return found

    def telling(group: frozenset) -> tuple:
        return min(map(len, group)), -len(group), sorted(group)

    def best(found: list[frozenset]) -> frozenset | None:
        return max(found, key=telling, default=None)

    groups = sorted(set(options(parser.parse(pattern))), key=telling, reverse=True)
    return tuple(tuple(sorted(g)) for i, g in enumerate(groups) if not i or min(map(len, g)) >= least)


def build_rules() -> list[Rule]:
    """All rules in order of priority: signatures, forms with versions, forms, identifiers, links."""
    rules = []

    def add(label: str, weight: float, pattern: str, end: str = r"(?!\w)") -> None:
        spaced = rf"(?<!\w)(?:{pattern.replace('[- ]', '(?:-| )')}){end}".replace(" ", GAP)
        rules.append(Rule(label, weight, re.compile(spaced), required_literals(spaced)))

    for label, weight, pattern in SIGNATURES:
        add(label, weight, pattern, "")
    for with_version in (True, False):
        for form, weight in FORMS:
            for label, (name, versions, _, _) in FAMILIES.items():
                body = form.format(name=name)
                if with_version:
                    for v in versions:
                        add(label, min(1.0, weight + 0.1), rf"{body},? ?\(?(?:version |v\.? ?|v)?{re.escape(v)}", r"(?![\w.]\d|\w)")
                else:
                    add(label, weight, body)
    for label, (_, _, stems, link) in FAMILIES.items():
        for stem in stems:
            add(label, 1.0, rf"spdx-license-identifier: ?{re.escape(stem)}[\w.+-]*", "")
        if link:
            add(label, 0.8, rf"{re.escape(link)}[\w./-]*", "")
    for label, weight, pattern in IDENTIFIERS:
        add(label, weight, pattern, r"(?![\w.]\d|\w)")
    return rules


class Scanner:
    """The rules and one automaton over the literals of their gates."""

    def __init__(self):
        import ahocorasick

        self.rules = build_rules()
        self.opened: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            if not rule.gate:
                raise ValueError(f"a rule without a required literal: {rule.pattern.pattern}")
            for k in rule.gate[0]:
                self.opened.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k in sorted({k for rule in self.rules for group in rule.gate for k in group}):
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def candidates(self, lowered: str) -> list[int]:
        """Rules whose gate the text passes, in order of priority."""
        held = {k for _, k in self.automaton.iter(lowered)}
        first = {i for k in held for i in self.opened.get(k, ())}
        return sorted(i for i in first if not any(held.isdisjoint(group) for group in self.rules[i].gate[1:]))

    def detect(self, lowered: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, weight) of the detections that stand, by position; `lowered` has no A-Z."""
        found = [(m.start(), m.end(), i, self.rules[i].label, self.rules[i].weight) for i in self.candidates(lowered) for m in self.rules[i].pattern.finditer(lowered)]
        # By start, longest first, then by priority: whatever ends no later than one before it is contained.
        found.sort(key=lambda x: (x[0], -x[1], x[2]))
        kept, reach = [], -1
        for start, end, _, label, weight in found:
            if end > reach:
                kept.append((start, end, label, weight))
                reach = end
        return kept


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def detect(lowered: str) -> list[tuple[int, int, str, float]]:
    return scanner().detect(lowered)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(lowered: str) -> list[tuple[int, str]]:
    """(word index, label) wherever a base phrase's words stand consecutively."""
    if "license" not in lowered:
        return []
    words = _WORD.findall(lowered)
    places, at = [], -1
    while True:
        try:
            at = words.index("license", at + 1)
        except ValueError:
            return sorted(places)
        for phrase, label in BASE:
            k = at - len(phrase) + 1
            if k >= 0 and tuple(words[k : at + 1]) == phrase:
                places.append((k, label))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts, labels and score, and `spans` ("label:start:end", code points) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            sizes = byte_lengths(column)
            for a, b in chunks(sizes):
                # bytes.lower() changes A-Z alone.
                texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in column.slice(a, b - a).to_pylist()]
                counts = Words(texts, ALNUM, hashed=False).counts()
                rows = []
                for raw, n in zip(texts, counts.tolist(), strict=True):
                    t = raw.decode("utf-8", "surrogatepass")
                    places, found = base_places(t), detect(t)
                    base = sorted({x for _, x in places})
                    score = 1.0 - float(np.prod([1.0 - w for *_, w in found])) if found else 0.0
                    rows.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *(x[2] for x in found)})), max(score, 0.6 if places else 0.0), ",".join(f"{x}:{s}:{e}" for s, e, x, _ in found)))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op9_license_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("spans")
