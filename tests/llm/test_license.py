import re

import regex

from inkwell.llm import license

TEXTS = [
    None, "", "   ...  ", "Nothing here, mit der Zeit.", "Under the MIT License. MIT license!", "MIT-License;mit,license", "mitlicense mit xlicense amit license",
    "cc by cc by cc-by 4.0", "GNU General Public License, version 3\nApache License 2.0", "é mit license é", "SPDX-License-Identifier: Apache-2.0",
    "This is licensed under the terms of the GNU General Public License v2. All rights reserved.", "cc by-nc-sa 4.0 and CC0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "K mit Kicense mit license İ", "a " * 4000 + "apache license " * 300,
    "gnu general public license gnu general public license", "released under the BSD 3-clause license", "public domain", "wtfpl",
]


def _brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license.BASE:
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    form = " " + " ".join(words) + " "
    found = [(m.start(), m.end(), label, priority, weight) for label, _, priority, weight, text in license.rules() for m in regex.finditer(text, form)]
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and b[3] >= a[3] and (b[:2] != a[:2] or b[3] > a[3] or (b[2], b[4]) < (a[2], a[4]))
    kept = [a for a in set(found) if not any(inside(a, b) for b in set(found))]
    kept = [a for a in kept if a[4] > 0.3] or kept
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {k[2] for k in kept})), max((k[4] for k in kept), default=0.0)


def test_equals_brute_force(spark):
    rows = [(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x", 3), (None, TEXTS[8], None, None)]
    out = license.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int"), text="text")
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score))
    assert len(by_id[4]) == 2 and by_id[None] == [_brute(TEXTS[8])]
    for i, text in enumerate(TEXTS):
        assert by_id[i][0] == _brute(text), (text or "")[:60]


def _examples(tree):
    """Texts of an expression: the shortest, the longest, and one for each branch and each repetition taken or not."""
    out = [""]
    for op, value in tree:
        name = str(op)
        if name in ("ASSERT_NOT", "AT") or name == "ASSERT" and (value[0] < 0 or len(value[1]) == 1):
            continue
        if name == "LITERAL":
            some = [chr(value)]
        elif name == "IN":
            some = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in value]
        elif name == "BRANCH":
            some = [t for part in value[1] for t in _examples(part)]
        elif name in ("SUBPATTERN", "ASSERT"):
            some = _examples(value[-1])
        elif name == "MAX_REPEAT":
            low, high, part = value
            some = [t * n for n in sorted({low, max(low, min(high, 2)) if high > 1 else high}) for t in _examples(part)]
        else:
            raise ValueError(name)
        out = [out[i % len(out)] + some[i % len(some)] for i in range(max(len(out), len(some)))] + [out[-1] + t for t in some[:6]]
    return list(dict.fromkeys(out))[:60]


def test_every_rule_is_found_in_examples_of_its_own(spark):
    rules = license.rules()
    assert len(rules) > 250 and len({r[4] for r in rules}) == len(rules)
    gate, texts = re.compile(license.GATE), []
    for label, keyword, priority, _, expression in rules:
        lead = "spdx license identifier " if keyword == "spdx" else "licensed under the " if priority == 2 else "apache 2 0 " if "(?<=apache 2 0 )" in expression else ""
        found = [lead + text for text in _examples(re._parser.parse(expression))]
        assert found
        for text in found:
            form = f" some {text} text "
            assert regex.search(expression, form), (expression, text)
            assert gate.search(form), (label, text)
            assert f" {keyword}" in form, (keyword, text)
        texts += found[:2] + found[-2:]
    for phrase, _ in license.BASE:
        assert gate.search(f" {phrase} ")
    got = _scan(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == _brute(text) and got[i][5], text


def test_empty_table(spark):
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def _scan(spark, texts):
    out = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out}


def test_versions_glued_to_the_name_are_found(spark):
    names = ["GPLv3", "GPL3", "GPLv2 or later", "LGPLv2.1", "LGPL3", "AGPLv3", "AGPL3", "SSPLv1", "SSPL1"]
    texts = [form % name for name in names for form in ("%s", "released under %s today", "SPDX-License-Identifier: %s")]
    got = _scan(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == _brute(text) and got[i][5], text


def test_identifiers_after_an_spdx_tag(spark):
    want = {"MIT": "mit", "Apache-2.0": "apache", "(MIT OR Apache-2.0)": "apache,mit", "GPL-3.0-or-later": "gpl", "LGPL-2.1-only": "lgpl", "BSD-3-Clause": "bsd", "ISC": "isc", "0BSD": "0bsd", "CC-BY-SA-4.0": "cc-by,cc-by-sa", "Zlib": "zlib", "Unlicense": "unlicense"}
    texts = [f"// SPDX-License-Identifier: {name}\nint main" for name in want]
    got = _scan(spark, texts)
    for i, (text, labels) in enumerate(zip(texts, want.values())):
        assert got[i] == _brute(text) and set(labels.split(",")) <= set(got[i][5].split(",")) and got[i][6] == 1.0, (text, got[i])


def test_line_separators_do_not_hide_phrases(spark):
    ends = ["\u2028", "\u2029", "\x85"]
    texts = [text for e in ends for text in (f"a{e}b mit license", f"mit license c{e}d apache license", f"mit license {e} apache license {e} cc by {e}")]
    got = _scan(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == _brute(text), ascii(text)


STATEMENTS = {
    "mit": [
        '"license": "MIT"', "License: MIT", "This is MIT-licensed.", "MIT/X11", "released under the MIT license", "Released under MIT.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
        "license = MIT", "Licensed under the terms of the MIT License", "see opensource.org/licenses/MIT", "SPDX-License-Identifier: MIT", "the mit licence applies",
    ],
    "isc": ["license: ISC", "ISC License", '"license" : "ISC",', "distributed under the ISC license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd": [
        "BSD licensed", "Copyright (c) 2020 The Authors. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "BSD 3-Clause License",
        "license: BSD-2-Clause", "under the new BSD license", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "GPL-licensed", "distributed under the GPL", "GPL version 2", "GPLv3+", "GNU GPL v2", "GNU General Public License", "license: GPL-3.0", "licensed under the GPL, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This file is free software: you can redistribute it and/or modify it", "http://www.gnu.org/licenses/gpl-3.0", "GPL 2.0 or later",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "AGPLv3", "GNU Affero General Public License",
        "You should have received a copy of the GNU Affero General Public License along with this program", "license: AGPL-3.0",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "LGPLv2.1", "GNU Lesser General Public License", "LGPL licensed",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License",
    ],
    "mpl": ["MPLv2", "MPL 2.0", "MPL v1.1", "Mozilla Public License", "license: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "epl": ["EPL v1.0", "EPL 2.0", "Eclipse Public License", "EPL-licensed"],
    "apache": ["Apache License, Version 2.0", "Apache-2.0", "license: Apache 2.0", "Apache licensed", "licensed under the Apache License", "http://www.apache.org/licenses/LICENSE-2.0", "Licensed under Apache 2"],
    "apache,mit": ["MIT/Apache-2.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT", "dual licensed under MIT / Apache-2.0"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "cc0": ["CC0", "license: CC0-1.0"],
    "zlib": ["zlib license", "License: Zlib", "This software is provided 'as-is', without any express or implied warranty"],
    "unlicense": ["The Unlicense", "license: Unlicense"],
    "wtfpl": ["WTFPL", "License: WTFPL"],
    "public-domain": ["This file is in the public domain.", "released into the public domain"],
    "proprietary": ["(c) 2019 Somebody Inc. All rights reserved.", "Proprietary and confidential", "Unauthorized copying of this file, via any medium is strictly prohibited"],
    "": [
        "music in the public domain", "she studied at MIT for years", "mit der Zeit und mit Geduld", "the apache tribe", "the bus driver has a licence to drive", "he lost his license mit dem Auto", "a zoo license plate",
        "the gnu grazed", "EPL results: two goals", "bsd is an operating system", "the general public", "licensed plumber", "released under pressure", "distributed under the table", "public domains of knowledge", "no license needed to fish",
        "the mozilla browser", "eclipse of the sun", "common development goals", "boost your software", "the artist licensed her song", "under the terms of the contract", "we reserve all rights in writing", "is free software you like",
    ],
}


def test_statements_labelled_by_hand(spark):
    """None of the statements is missed or mislabelled, and no line of prose is hit."""
    pairs = [(text, labels) for labels, texts in STATEMENTS.items() for text in texts]
    assert len(pairs) >= 100
    got = _scan(spark, [text for text, _ in pairs])
    assert [(t, got[i][5]) for i, (t, labels) in enumerate(pairs) if got[i][5] != labels] == []


def test_a_licence_suppresses_a_weak_sign_and_kept_names_must_not_clash(spark):
    import pytest

    got = _scan(spark, ["All rights reserved.", "MIT License. All rights reserved.", "All rights reserved. Proprietary and confidential."])
    assert [(got[i][5], got[i][6]) for i in range(3)] == [("proprietary", 0.3), ("mit", 0.7), ("proprietary", 0.95)]
    with pytest.raises(ValueError):
        license.scan(spark.createDataFrame([(1, "x", 2.0)], "doc_id long, text string, Score double"), keep=("doc_id", "Score"))


def test_base_columns_equal_sql(spark):
    import os

    import duckdb
    import pytest

    from inkwell.llm.q_license import op9_license_scan

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables are not here")
    phrases = " UNION ALL ".join(f"SELECT '{p}' AS phrase, '{label}' AS label, {len(p.split())} AS size" for p, label in license.BASE)
    want = duckdb.connect().sql(f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM '{data}/documents.parquet'),
p AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), ({phrases}) WHERE array_to_string(w[i + 1:i + size], ' ') = phrase)
SELECT d.doc_id, len(w) AS n_words, count(p.i) AS n_base, min(p.i) AS first_word, max(p.i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id, len(w)""").fetchall()
    got = op9_license_scan(spark, data).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_base for r in got) > 0
