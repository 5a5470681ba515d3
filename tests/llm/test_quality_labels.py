"""Verdicts of op5_quality_rules against the labels and against brute force."""

import math
from collections import Counter

import pandas as pd
import pytest
from shapeloom.llm import flat, quality, registry

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_error_rates_on_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = registry.queries()["op5_quality_rules"](spark, SF).join(labels, "doc_id").where("not base_failed").toPandas()
    bad, good = got[got.quality == 0].kept, got[got.quality == 1].kept
    assert len(bad) > 20 and len(good) > 200
    assert bad.mean() <= 0.02 and (~good).mean() <= 0.01


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_verdicts_equal_brute_force(spark, most):
    """Ratios from dictionaries of words and pairs of words that share a bucket, with the trusted ids broadcast and joined by shuffle."""
    docs, labels = (pd.read_parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    trusted = set(labels[labels.quality == 1].doc_id)
    rules = quality.Rules(broadcast_bytes=most)
    space = " \t\n\x0b\x0c\r"

    def grams(text):
        words = "".join(" " if c in space else c for c in text or "").split(" ")
        words = [w for w in words if w]
        h, _ = flat.words([text], flat.NOT_SPACE, lower=False)
        assert len(h) == len(words)
        with_pairs = [int(x) for x in h]
        for a, b in zip(h.tolist(), h.tolist()[1:]):
            x = (a * 0xC2B2AE3D27D4EB4F + b) % (1 << 64)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = ((x ^ (x >> shift)) * factor) % (1 << 64)
            with_pairs.append(x ^ (x >> 31))
        return [x % rules.buckets for x in with_pairs], len(words)

    raw, target, each = Counter(), Counter(), {}
    for r in docs.itertuples():
        each[r.doc_id] = grams(r.text)
        raw.update(each[r.doc_id][0])
        if r.doc_id in trusted:
            target.update(each[r.doc_id][0])
    n_raw, n_target = sum(raw.values()) + rules.buckets, sum(target.values()) + rules.buckets
    ratio = lambda k: math.log((target[k] + 1) / n_target) - math.log((raw[k] + 1) / n_raw)
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    log_ratio = quality.ratios(table, spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").select("doc_id"), rules)
    for r in quality.judged(table, log_ratio, rules).collect():
        found, n = each[r.doc_id]
        mean = sum(map(ratio, found)) / len(found) if found else None
        assert r.n_words == n and (r.llr is None) == (mean is None) and (mean is None or abs(r.llr - mean) < 1e-9)
        assert r.kept == (not r.base_failed and mean is not None and mean >= rules.least)
