"""License scans with a positional index of rare words, in DataFrame functions only.

Each template is a list of words, and its words of highest IDF (over the templates) are its rare words. Of a file, the
rare words that stand in it are looked up by falling IDF, for each template as many as any match must hold one of: a
template of which too little stands in the file is left at once, and the words after the last one looked up are too few
to make a match alone, so nothing is lost. A place of a word looked up, less its place in the template, proposes where
the template would begin; the postings of the template's other rare words are intersected with the file's words at the
same relative positions, and a template is found where enough of their IDF agrees and every mandatory phrase stands in
its span.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base phrases, found where all their words stand.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening words of public licences and their usual notices; label, words, mandatory phrases.
NOTICES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "this program is made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("bsl-1.0", "boost software license version 1 0", ["boost software license"]),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ["will the authors be held liable for any damages"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international", ["attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", ["attribution noncommercial 4 0"]),
    ("artistic-2.0", "the artistic license 2 0", ["artistic license 2 0"]),
]
#: Identifiers that may stand after "SPDX-License-Identifier:".
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Zlib", "ISC", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
NOTICES += [(x.lower(), f"spdx license identifier {x.lower().replace('-', ' ').replace('.', ' ')}", [f"identifier {x.lower().replace('-', ' ').replace('.', ' ')}"]) for x in SPDX]
#: Share, in thousandths, of the rare words' IDF that must agree; rare words of a notice.
COVER, RARE = 600, 6
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates() -> list[dict]:
    """id, label, base, n (words), rare [(position, word, idf)] by falling idf, total, phrases. IDF is an integer so that sums are exact."""
    raw = [(label, phrase, [phrase], True) for phrase, label in BASE.items()] + [(*x, False) for x in NOTICES]
    df = Counter(w for _, text, _, _ in raw for w in set(text.split()))
    out = []
    for k, (label, text, phrases, base) in enumerate(raw):
        words = text.split()
        ranked = sorted(((i, w, round(1000 * math.log(1 + len(raw) / df[w]))) for i, w in enumerate(words)), key=lambda x: (-x[2], x[0]))
        rare = ranked if base else ranked[:RARE]
        out.append({"id": k, "label": label, "base": base, "n": len(words), "rare": rare, "total": sum(x[2] for x in rare), "phrases": phrases})
    return out


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and found (label, start, cover).

    A null text is empty: no words, no places, empty labels, null first and last word, score 0. Labels are distinct,
    sorted and joined by commas; score is the largest share of a found template's IDF that agrees. Rows are scanned one
    by one without a shuffle; existing columns of these names are replaced.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]
    every = templates()
    body = ", ".join(
        f"named_struct('t', {t['id']}, 'label', '{t['label']}', 'base', {str(t['base']).lower()}, 'n', {t['n']}, 'total', {t['total']}, 'need', {1000 if t['base'] else COVER}, "
        f"'rare', array({', '.join(f"named_struct('p', {i}, 'w', '{w}', 'idf', {x})" for i, w, x in t['rare'])}), 'phrases', array({', '.join(f"' {p} '" for p in t['phrases'])}))"
        for t in every
    )
    body = f"array({body})"
    rarest = sorted({(-i, w) for t in every for _, w, i in t["rare"]})
    rare = "array(" + ", ".join(f"'{w}'" for _, w in rarest) + ")"
    x = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), _SEPARATORS).alias("__w"))
    # separators at an end of the text leave an empty word there
    x = x.withColumn("__lead", F.expr("int(__w[0] = '')")).withColumn("n_words", F.expr("cast(size(__w) - __lead - int(size(__w) > 1 and __w[size(__w) - 1] = '') as long)"))
    x = x.withColumn("__here", F.expr(f"array_intersect({rare}, __w)"))
    # a rare word is looked up while it and those after it could make a match without the words before it
    left = "aggregate(slice(r, k + 1, size(r)), 0, (sum, y) -> sum + y.idf)"
    looked = f"filter(transform(array(filter(t.rare, r -> array_contains(__here, r.w))), r -> transform(r, (y, k) -> named_struct('w', y.w, 't', t.t, 'p', y.p, 'left', {left})))[0], y -> y.left * 1000 >= t.need * t.total)"
    x = x.withColumn("__keys", F.expr(f"case when size(__here) > 0 then flatten(transform({body}, t -> {looked})) end"))
    x = x.withColumn("__hits", F.expr("case when size(__keys) > 0 then filter(transform(__w, (w, i) -> named_struct('w', w, 'i', i)), h -> exists(__keys, y -> y.w = h.w)) end"))
    # template and start in one number: distinct numbers are hashed, distinct structs would be compared in pairs
    starts = f"transform(array_distinct(flatten(transform(__hits, h -> transform(filter(__keys, y -> y.w = h.w and h.i >= y.p), y -> cast(h.i - y.p as long) * {len(every)} + y.t)))), c -> named_struct('t', cast(c % {len(every)} as int), 's', cast(c div {len(every)} as int)))"
    x = x.withColumn("__starts", F.expr(f"case when __hits is not null then {starts} end"))
    agree = "aggregate(t.rare, 0, (sum, r) -> sum + if(get(__w, c.s + r.p) = r.w, r.idf, 0))"
    tried = f"transform(__starts, c -> transform(array(element_at({body}, c.t + 1)), t -> named_struct('label', t.label, 'base', t.base, 'start', c.s - __lead, 'cover', {agree}, 'total', t.total, 'need', t.need, 'phrases', t.phrases, 'span', concat(' ', array_join(slice(__w, c.s + 1, t.n), ' '), ' ')))[0])"
    good = f"filter({tried}, c -> c.cover * 1000 >= c.need * c.total and forall(c.phrases, p -> contains(c.span, p)))"
    x = x.withColumn("found", F.expr(f"coalesce(transform(case when size(__starts) > 0 then {good} end, c -> named_struct('label', c.label, 'base', c.base, 'start', cast(c.start as long), 'cover', c.cover / c.total)), array())"))
    base = "filter(found, c -> c.base)"
    x = x.withColumns(
        {
            "n_base": F.expr(f"cast(size({base}) as long)"),
            "first_word": F.expr(f"array_min(transform({base}, c -> c.start))"),
            "last_word": F.expr(f"array_max(transform({base}, c -> c.start))"),
            "base_labels": F.expr(f"array_join(array_sort(array_distinct(transform({base}, c -> c.label))), ',')"),
            "labels": F.expr("array_join(array_sort(array_distinct(transform(found, c -> c.label))), ',')"),
            "score": F.expr("coalesce(array_max(transform(found, c -> c.cover)), 0D)"),
        }
    )
    return x.drop("__w", "__lead", "__here", "__keys", "__hits", "__starts")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle() -> str:
    """The same rows in SQL, from every place of every rare word."""
    every = templates()
    values = lambda rows: ", ".join(str(r) for r in rows)
    tpl = values((t["id"], t["label"], t["base"], t["n"], t["total"], 1000 if t["base"] else COVER) for t in every)
    rare = values((t["id"], i, w, x) for t in every for i, w, x in t["rare"])
    phrase = values((t["id"], f" {p} ") for t in every for p in t["phrases"])
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
tpl(t, label, base, n, total, need) AS (VALUES {tpl}), rare(t, p, w, idf) AS (VALUES {rare}), phrase(t, ph) AS (VALUES {phrase}),
pos AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
hit AS (SELECT doc_id, t, i - p AS s, sum(idf) AS cover FROM pos JOIN rare USING (w) WHERE i >= p GROUP BY ALL),
good AS (SELECT h.doc_id, h.t, h.s, h.cover, tpl.* EXCLUDE (t), ' ' || array_to_string(d.ws[s + 1 : s + n], ' ') || ' ' AS span FROM hit h JOIN tpl USING (t) JOIN d ON d.doc_id = h.doc_id WHERE cover * 1000 >= need * total),
found AS (SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM phrase p WHERE p.t = g.t AND NOT contains(g.span, p.ph))),
per AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover / total) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""
