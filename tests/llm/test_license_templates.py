import random
from collections import Counter

import pytest

from mediasift.llm import licenses
from mediasift.llm.license_templates import WORDINGS

MIT = """Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
FSF = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
GOOGLE = "\n3. Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

NOTICES = [
    (MIT, "MIT"),
    ("Licensed under the MIT License.", "MIT"),
    (FSF.format("program", ";", "", ";", "2"), "GPL-2.0"),
    (FSF.format("program", ":", "", ",", "3"), "GPL-3.0"),
    (FSF.format("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1"),
    (FSF.format("program", ":", "Lesser ", ",", "3"), "LGPL-3.0"),
    (FSF.format("program", ":", "Affero ", ",", "3"), "AGPL-3.0"),
    (BSD, "BSD-2-Clause"),
    (BSD + GOOGLE, "BSD-3-Clause"),
    (ISC, "ISC"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("under the Apache License, Version 3.0", None),
]


def test_notices_and_their_near_misses(spark):
    rows = [(i, pre + text + post) for i, (text, _) in enumerate(NOTICES) for pre, post in (("", ""), ("one two three four.\n", "\nfive six seven eight"))]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and [(NOTICES[x.doc_id][1], 1 if NOTICES[x.doc_id][1] else 0) for x in got] == [(x.license, x.n_matches) for x in got]


def test_each_wording_names_its_own_licence():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.DICE)
    for name, texts in WORDINGS.items():
        for text in texts:
            assert [(x[0], x[3]) for x in scanner.matches(f"a b c d {text} e f g h")] == [(name, 1.0)]


def brute(text, templates, t):
    """Every passage against every template; then the best of overlapping ones."""
    w, found = licenses.words(text), []
    for key, own in templates.items():
        b = Counter(licenses.bigrams(licenses.words(own)))
        n, best = min(len(w), b.total() + 1), None
        for s in range(len(w) - n + 1) if n > 1 else ():
            p = Counter(licenses.bigrams(w[s : s + n]))
            score = licenses.dice(p, b)
            if score >= t:
                x = (-(p & b).total(), -score, s, key.partition("#")[0], s + n)
                if best and s < best[4]:
                    best = x if x[1] < best[1] else best
                else:
                    found += [best] if best else []
                    best = x
        found += [best] if best else []
    kept = []
    for x in sorted(found):
        if all(x[4] <= y[2] or y[4] <= x[2] for y in kept):
            kept.append(x)
    inside = [[y for y in found if y[3] == x[3] and x[2] <= y[2] and y[4] <= x[4]] for x in kept]
    best = [min(ys, key=lambda y: (y[1], y)) for ys in inside]
    return sorted((x[3], x[2], x[4], pytest.approx(-x[1])) for x in best)


def test_scanner_equals_brute_force():
    r = random.Random(5)
    templates = {"A": "a b c d e", "A#1": "a b a b a c", "B": "b c d", "C": "c d e a b c d e a b", "D": "a a a a", "E": "e"}
    scanner, seen = licenses.Scanner(templates, 0.6), 0
    for _ in range(400):
        text = " ".join(r.choice("aaabbcde") if r.random() < 0.6 else r.choice(["a b c d e", "c d e", "a a"]) for _ in range(r.randrange(0, 40)))
        got = sorted(scanner.matches(text))
        assert got == brute(text, templates, 0.6)
        seen += len(got)
    assert seen > 500


def test_rows_that_are_empty_repeated_long_or_oddly_named(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    long_ = " ".join(["filler words that are no licence"] * 4000 + [mit] + ["and more filler that is none"] * 4000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Permission"), (5, mit), (5, mit), (None, mit), (6, long_), (7, mit.upper())]
    df = spark.createDataFrame([(*r, "GPL", 9, "x") for r in rows], "doc_id long, text string, license string, matches int, best string")
    found = licenses.scan_licenses(df).collect()
    assert len(found) == len(rows)
    of = lambda k: [r for r in found if r.doc_id == k]
    assert all(r.license is None and r.score == 0.0 and r.n_matches == 0 for k in (1, 2, 3, 4) for r in of(k))
    assert len(of(5)) == 2 and of(5)[0] == of(5)[1] and of(5)[0].license and of(None)[0].license == of(5)[0].license
    assert of(6)[0].license == of(5)[0].license and of(6)[0].matches[0]["first"] > 20_000 and of(7)[0].score == of(5)[0].score
    assert licenses.scan_licenses(df.limit(0)).count() == 0
