"""Licence labels of known wordings, suppression against a plain version, long texts."""

import random
import time

import pytest

from turnspark.llm import license_scan as ls
from turnspark.llm.words import folded_words

RULES = ls.signature_rules()


def framed(text):
    return b" " + b" ".join(folded_words(text.encode())) + b" "


def labels(text):
    return sorted({r.label for _, _, r in ls.detections(framed(text), RULES)})


@pytest.mark.parametrize("text, want", [
    ("GNU Lesser General Public License version 2.1", ["lgpl-2.1"]),
    ("GNU Lesser General Public Licence", ["lgpl"]),
    ("3-clause BSD license", ["bsd-3-clause"]),
    ("SPDX-License-Identifier: LGPL-2.1-only", ["lgpl-2.1"]),
    ("GPL-2.0-or-later", ["gpl-2+"]),
    ("SPDX-License-Identifier: GPL-3.0-or-later", ["gpl-3+"]),
    ("Permission is hereby granted, free of charge", ["mit"]),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", ["bsl-1.0"]),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or "
     "(at your option) any later version", ["gpl-2+"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", ["bsd"]),
    ("CC BY-SA 4.0", ["cc-by-sa-4.0"]), ("released under the MIT license and the Apache License, Version 2.0", ["apache-2.0", "mit"]),
    ("a licence to print money", []), ("", []),
])
def test_known_wordings(text, want):
    assert labels(text) == want


def plain(text):
    """The same laws by comparing every span with every other one."""
    every = list(ls.matches(text, RULES))

    def beaten(x, y):
        inside = y[0] <= x[0] and x[1] <= y[1]
        if inside and y[:2] == x[:2]:
            return (-y[2].priority, y[2].label) < (-x[2].priority, x[2].label)
        return inside

    outer = {(s, e, r.priority, r.label) for s, e, r in every if not any(beaten((s, e, r), y) for y in every)}
    out = []
    for s, e, p, label in sorted(outer, key=lambda d: (-d[2], d[0] - d[1], d[0])):
        if all(e <= a or b <= s for a, b, *_ in out):
            out.append((s, e, p, label))
    return sorted(out)


def test_suppression_is_that_of_all_pairs():
    rng = random.Random(8)
    parts = ("gnu lesser general public license version 2 1 0 or later at your option any released under the terms of mit apache software "
             "bsd 3 clause new spdx identifier gpl lgpl cc by sa nc 4 creative commons attribution all rights reserved is hereby granted free").split()
    for _ in range(300):
        text = framed(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))))
        assert sorted((s, e, r.priority, r.label) for s, e, r in ls.detections(text, RULES)) == plain(text)


def test_every_keyword_stands_in_its_rules_matches():
    for text in ("GNU Affero General Public License v3", "unlicense", "CeCILL license 2.1", "zlib libpng license", "revised BSD license"):
        assert labels(text)
    assert 700 < len(RULES) and len({r.keyword for r in RULES}) > 60


def test_five_megabytes(spark):
    line = "Released under the GNU Lesser General Public License version 2.1.\nMIT license\n"
    n = 5_000_000 // len(line)
    start = time.time()
    row = ls.scan(spark.createDataFrame([(1, line * n)], "doc_id long, text string")).drop("spans").first()
    assert time.time() - start < 60
    assert (row["labels"], row["n_base"], row["first_word"]) == ("gpl,lgpl-2.1,mit", 2 * n, 5) and row["n_words"] == 13 * n
