"""The pipeline's stages against brute force on a small table."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from test_llm import SCHEMA, closed, made, plain_bpe, removed_lines, simple_fingerprint

from treeloom.llm import language_id, mixing


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(2).cache()


def stage(name, spark, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, "")


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "byte_bpe"]


def test_language_stage(spark, docs):
    got = stage("language_id", spark, docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in made() if r[1] and language_id.LETTER.search(r[1]))


def test_line_stage(spark, docs):
    gone = removed_lines(made())
    got = stage("line_dedup", spark, docs)
    assert got.columns == docs.columns
    want = Counter()
    for r in made():
        out = gone[-1 if r[0] is None else r[0]]
        want[r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in out)] += 1
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_simhash_stage(spark, docs):
    rows = [r for r in made() if r[0] is not None]
    fp = {r[0]: simple_fingerprint(r[1], 5) for r in rows}
    ids = sorted(fp)
    label = closed(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = stage("simhash_dedup", spark, docs.where("doc_id is not null"))
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == set(label.values())


def test_mixing_stage(spark, docs):
    plan = mixing.mix(docs).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.taken
    words = re.compile(r"[^\x20\x09-\x0D]+").findall
    got, texts = Counter(), {r[0]: r[1] for r in made()}
    out = stage("mixing", spark, docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert Counter(words(r.text)) <= Counter(words(texts[r.doc_id]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_all_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known, rows = plain_bpe(), docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(f(spark, rows, str(tmp_path)).collect(), SCHEMA)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(known.encode_ordinary(r.text or ""))) for r in rows.collect())
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), str(tmp_path)).collect() == []
