"""One row of each class stays where ids are null or stand on several rows."""

import random


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_near_duplicates_by_class(spark):
    import corpus_pipeline

    a, b, c, d, e = (words(60, k) for k in range(5))
    rows = [(None, a), (None, a), (None, b), (1, c), (None, c), (2, d), (2, e), (3, d), (4, ""), (None, ""), (None, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r.doc_id or 0, r.text) for r in got)) == sorted([(0, a), (0, b), (1, c), (2, d), (2, e), (4, ""), (0, ""), (0, "")])
