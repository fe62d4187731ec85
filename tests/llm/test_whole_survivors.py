"""Exactly one document of each near-duplicate group stays."""

from collections import Counter

import corpus_pipeline
from test_llm import SCHEMA


def test_one_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    texts = [(1, a), (1, a), (2, a), (None, a + " end"), (None, b), (None, b), (None, b + " end"), (5, c), (5, c + " end"), (6, None), (6, ""), (None, "alone, with no id")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 2, "x") for i, t in texts], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.simhash_stage(spark, docs, "").collect())
    assert got[1, a] == 1
    assert got[None, b] + got[None, b + " end"] == 1
    assert got[5, c] + got[5, c + " end"] == 1
    assert got[6, None] + got[6, ""] == 1
    assert got[None, "alone, with no id"] == 1
    assert got.total() == 5
