"""License scans against all places of all templates, tried one by one."""

import random
import re
import time

from shapeloom.llm import licenses


def places(text):
    """(label, start, base) of every template at every word of the text."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    out = set()
    for t in licenses.templates():
        need = 1000 if t["base"] else licenses.COVER
        for s in range(len(words)):
            cover = sum(x for i, w, x in t["rare"] if s + i < len(words) and words[s + i] == w)
            span = f" {' '.join(words[s : s + t['n']])} "
            if cover * 1000 >= need * t["total"] and all(f" {p} " in span for p in t["phrases"]):
                out.add((t["label"], s, t["base"]))
    return out


def test_equal_to_all_places(spark):
    rng = random.Random(5)
    every = [t for _, t, _ in licenses.NOTICES] + list(licenses.BASE)
    pool = sorted({w for t in every for w in t.split()})
    texts = ["", " -- ", "MIT", "mit mit license", "all rights reserved " * 40]
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(every).split()
            for _ in range(rng.choice((0, 0, 1, 2, 4, 6))):
                t[rng.randrange(len(t))] = rng.choice(pool + ["x"])
            words += [rng.choice(pool) for _ in range(rng.randint(0, 5))] + t[: rng.choice((len(t), len(t), 5))]
        texts.append(rng.choice(("", "-")) + rng.choice((" ", ", ")).join(words).title() + rng.choice(("", ".")))
    got = licenses.scan(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")).select("doc_id", "found").collect()
    assert {r.doc_id: {(c.label, c.start, c.base) for c in r.found} for r in got} == {i: places(x) for i, x in enumerate(texts)}
    assert sum(not b for r in got for _, _, b in [(c.label, c.start, c.base) for c in r.found]) > 200


def test_notice_without_its_rarest_words(spark):
    # a changed word is no reason to lose a notice whose other rare words and phrases stand
    t = next(t for t in licenses.templates() if t["label"] == "bsd")
    words = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met".split()
    free = [i for i, _, _ in t["rare"] if words[i] not in "redistribution and use in source and binary forms".split()][:1]
    for i in free:
        words[i] = "changed"
    got = licenses.scan(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert got.labels == ("bsd" if free else got.labels) and got.score >= 0.6


def test_time_grows_with_the_places(spark):
    docs = spark.createDataFrame([(1, "all rights reserved. the gnu general public license " * 60_000)], "doc_id long, text string")
    begin = time.time()
    assert licenses.scan(docs).first().n_base == 60_000 and time.time() - begin < 60


def test_identifiers_and_clauses(spark):
    texts = {
        "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "# spdx-license-identifier: GPL-2.0-or-later": "gpl-2.0", "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0",
        "In no event will the authors be held liable for any damages arising from the use of this software.": "zlib", "Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd", "SPDX-License-Identifier: Mitten": "", "an attribution of commons that is creative": "",
    }
    got = {r.text: r.labels for r in licenses.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == texts
