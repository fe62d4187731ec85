"""The mixing stage on repeated rows, and what it does not sort or shuffle."""

import re
from collections import Counter

import corpus_pipeline
from test_llm import SCHEMA

from treeloom.llm import mixing, stages

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def rows():
    own = [(i, " ".join(f"w{i}x{k}" for k in range(1 + i % 40)), "en", "abc"[i % 3], 1, 2, "x") for i in range(120)]
    twice = [(500 + i // 3, f"some words of {i // 3} " * 9, "en", "a" if i % 2 else None, i, 2, "y") for i in range(30)]
    return own + twice + [(None, "no id at all", "de", None, 1, 2, "z")] * 3 + [(900, None, "en", "b", 0, 0, "n"), (901, "", "en", "b", 0, 0, "n")]


def test_repeated_rows_get_their_plans(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += r.taken
    out = corpus_pipeline.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id, r.source] += len(WORDS(r.text))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_texts_are_not_sorted_for_a_plan(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for few in (True, False):
        monkeypatch.setattr(stages, "small", lambda df, few=few: few)
        out = corpus_pipeline.mixing_stage(spark, docs, "")
        assert out.count() > 100
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # only repeated rows come to the window
        at = plan.split("Window [")
        assert len(at) == 2 and "LeftSemi" in at[1].split("Relation")[0].split("LogicalRDD")[0]
