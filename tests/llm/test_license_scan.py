"""License scan: every rule on examples of every alternative, gates, containment, base columns by brute force."""

import random
import re
import re._constants as code
import re._parser as parser

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import hard_rows, passage
from weft.llm import license_scan
from weft.llm.license_scan import GAP

NAMES = {
    "agpl": ["GNU Affero General Public License"], "lgpl": ["GNU Lesser General Public License", "GNU Library General Public Licence"], "gpl": ["GNU General Public License"],
    "gfdl": ["GNU Free Documentation License"], "apache": ["Apache License", "Apache Software License"], "mit": ["MIT License"], "bsd": ["BSD License", "New BSD License", "Simplified BSD License", "Modified BSD License"],
    "mpl": ["Mozilla Public License"], "epl": ["Eclipse Public License"], "cddl": ["Common Development and Distribution License"], "cpl": ["Common Public License"], "eupl": ["European Union Public Licence"],
    "artistic": ["Artistic License", "Perl Artistic License"], "boost": ["Boost Software License"], "isc": ["ISC License"], "zlib": ["zlib License", "zlib/libpng License"], "unlicense": ["The Unlicense", "The Unlicence"],
    "wtfpl": ["Do What The F*** You Want To Public License"], "osl": ["Open Software License"], "ofl": ["SIL Open Font License"], "psf": ["Python Software Foundation License"], "upl": ["Universal Permissive License"],
    "ms-pl": ["Microsoft Public License"], "ms-rl": ["Microsoft Reciprocal License"], "sspl": ["Server Side Public License"], "busl": ["Business Source License"], "odbl": ["Open Database License", "Open Data Commons Database License"],
    "cc0": ["CC0", "Creative Commons Zero"], "cc-by-nc-nd": ["CC BY-NC-ND", "CC-BY-NC-ND", "Creative Commons Attribution-NonCommercial-NoDerivatives"],
    "cc-by-nc-sa": ["CC BY-NC-SA", "CC-BY-NC-SA", "Creative Commons Attribution-NonCommercial-ShareAlike"], "cc-by-nc": ["CC BY-NC", "CC-BY-NC", "Creative Commons Attribution-NonCommercial"],
    "cc-by-nd": ["CC BY-ND", "CC-BY-ND", "Creative Commons Attribution-NoDerivs"], "cc-by-sa": ["CC BY-SA", "CC-BY-SA", "Creative Commons Attribution-ShareAlike"], "cc-by": ["CC BY", "CC-BY", "Creative Commons Attribution"],
    "public-domain": ["Public Domain"], "proprietary": ["All rights reserved"], "afl": ["Academic Free License"], "ecl": ["Educational Community License"], "php": ["PHP License"], "ruby": ["Ruby License"], "lppl": ["LaTeX Project Public License"],
    "postgresql": ["PostgreSQL Licence"], "openssl": ["OpenSSL License"], "ncsa": ["University of Illinois/NCSA Open Source License"], "mulan": ["Mulan Permissive Software License"], "blueoak": ["Blue Oak Model License"],
    "cecill": ["CeCILL License"], "zpl": ["Zope Public License"], "elastic": ["Elastic License"],
}


POOL = "abcdefghijklmnopqrstuvwxyz0123456789 '*./-\n\t\"#;%>|!“”‘’`\x0b\r"


def examples(pattern, rng, n=12):
    """Random texts that the pattern matches, from its parsed form; look-arounds add nothing."""

    def some(items):
        out = ""
        for op, arg in items:
            if op is code.LITERAL:
                out += chr(arg)
            elif op is code.SUBPATTERN:
                out += some(arg[3])
            elif op in (code.MAX_REPEAT, code.MIN_REPEAT):
                out += "".join(some(arg[2]) for _ in range(rng.randrange(arg[0], min(arg[1], arg[0] + 2) + 1)))
            elif op is code.BRANCH:
                out += some(rng.choice(arg[1]))
            elif op is code.IN:
                out += next(c for c in rng.sample(POOL, len(POOL)) if re.fullmatch(as_class(arg), c))
            elif op is code.NOT_LITERAL:
                out += "z"
            elif op not in (code.ASSERT, code.ASSERT_NOT, code.AT):
                raise AssertionError(op)
        return out

    return [some(parser.parse(pattern)) for _ in range(n)]


def as_class(items):
    names = {code.CATEGORY_WORD: r"\w", code.CATEGORY_NOT_SPACE: r"\S", code.CATEGORY_SPACE: r"\s", code.CATEGORY_DIGIT: r"\d"}
    body = "".join("^" if op is code.NEGATE else re.escape(chr(arg)) if op is code.LITERAL else f"{re.escape(chr(arg[0]))}-{re.escape(chr(arg[1]))}" if op is code.RANGE else names[arg] for op, arg in items)
    return f"[{body}]"


def test_every_rule_passes_its_own_gate():
    rng, scanner = random.Random(1), license_scan.scanner()
    for i, rule in enumerate(scanner.rules):
        for text in examples(rule.pattern.pattern, rng):
            assert rule.pattern.search(text), (rule.pattern.pattern, text)
            assert i in scanner.candidates(text), (rule, text)


def test_rules_are_many_and_ordered():
    rules = license_scan.scanner().rules
    assert len(rules) > 500 and len(license_scan.SIGNATURES) > 100
    assert all(rule.gate and min(map(len, rule.gate[0])) >= 2 for rule in rules)


def test_gate_drops_nothing():
    """All rules without their gates, and containment pair by pair, give the same detections."""
    rng, rules = random.Random(2), license_scan.scanner().rules
    filler = ["the", "of", "under", "license", "by", "cc", "gnu", "public", "no", "version 2.0", "apache", "\n", "* ", "(c)"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [rng.choice(filler) for _ in range(rng.randrange(6))] + examples(rng.choice(rules).pattern.pattern, rng, 1)
        text = " ".join(parts).lower()
        found = [(m.start(), m.end(), i) for i, r in enumerate(rules) for m in r.pattern.finditer(text)]
        stands = lambda x: not any((y[0] <= x[0] and x[1] <= y[1]) and (y[:2] != x[:2] or y[2] < x[2]) for y in found if y != x)
        want = sorted((s, e, rules[i].label, rules[i].weight) for s, e, i in found if stands((s, e, i)))
        assert license_scan.detect(text) == want, text


def test_each_name_alone(spark):
    """With no other text that might hold its literals, on one line and broken over lines of a comment."""
    assert set(NAMES) == set(license_scan.FAMILIES)
    names = [(label, name) for label, found in NAMES.items() for name in found]
    texts = [(label, form(name)) for label, name in names for form in (str, lambda n: f"Released under the {n}", lambda n: n.replace(" ", "\n"), lambda n: "# Released under\n# the " + n.replace(" ", "  \r\n  # "), lambda n: " * " + n.replace(" ", "\n *\n * "))]
    texts += [(label, f"Released under the terms of the {name}\n// version {v}") for label, name in names for v in license_scan.FAMILIES[label][1][:1]]
    texts += [("cc-by-sa", "Released under the Creative Commons Attribution-ShareAlike 4.0 International License."), ("apache", "see apache-2.0"), ("gpl", "GPLv3+"), ("bsd-3-clause", "a BSD 3-Clause License"), ("gpl", "GNU General Public\nLicense version 2")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    wrong = [(t, label, got[i]["spans"]) for i, (label, t) in enumerate(texts) if {x.split(":")[0] for x in got[i]["spans"].split(",")} != {label} or got[i]["score"] < 0.6]
    assert not wrong


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files", "mit"),
        ("Redistribution and use in source and binary forms, with or without\n# modification, are permitted", "bsd"),
        ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation", "gpl"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("Neither the name of the Example Org nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
        ("No part of this publication may be reproduced", "proprietary"),
    ],
)
def test_notices(text, label):
    found = license_scan.detect(text.lower())
    assert found[0][2] == label and found[0][3] >= 0.8


def test_ordinary_prose_has_none():
    for t in ("the committee may not copy the model in version 2.0 of its plan", "he said the public was free to use the river", "mit freundlichen worten", "access by the open door"):
        assert license_scan.detect(t) == []


def test_contained_detections_go():
    found = license_scan.detect("this is under the gnu lesser general public license version 2.1 here")
    assert [x[2] for x in found] == ["lgpl"]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    places = sorted((i, label) for i in range(len(words)) for label, p in phrases.items() if words[i : i + len(p)] == p)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_base_columns_by_brute_force(hard, spark):
    """All clashing columns stay in the input; the base labels stay in the output."""
    rng = random.Random(8)
    pieces = ["mit", "license", "apache", "general", "public", "MIT License", "İ", "K", "é", "-", "\n", ".", "licenses", "1"]
    extra = [(100 + i, rng.choice([" ", "-", "\x85"]).join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(200)]
    extra += [(90, "MIT License and the mit  license; Apache-License, GENERAL public\nlicense. summit license"), (91, "license mit"), (92, "Licensed under the Apache License, Version 2.0.")]
    rows = [(i, t) for i, t, *_ in hard_rows()] + extra + extra[:5]
    d = hard.unionByName(spark.createDataFrame(extra + extra[:5], "doc_id long, text string"), allowMissingColumns=True)
    out = license_scan.scan(d.withColumn("labels", F.lit("clash"))).collect()
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(((r["doc_id"] or 0, *[r[c] for c in columns]) for r in out), key=repr) == sorted(((i or 0, *base(t)) for i, t in rows), key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)
    long = next(r for r in out if r["doc_id"] == 92)
    assert long["labels"] == "apache" and long["spans"].startswith("apache:0:") and long["score"] > 0.9


def test_very_long_text_and_gaps(spark):
    d = spark.createDataFrame([(1, passage(random.Random(1), 60_000) + " MIT\n * License"), (2, "mit " * 50_000 + "license"), (3, "released under " * 20_000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.scan(d).collect()}
    assert out[1]["labels"] == "mit" and out[2]["n_base"] == 1 and out[3]["labels"] == ""
    assert re.fullmatch(GAP, "\n  # ") and not re.fullmatch(GAP, "#")
