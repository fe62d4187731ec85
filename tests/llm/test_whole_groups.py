"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import itertools
import random

import corpus_pipeline
import numpy as np
from test_llm import SCHEMA, closed, made

from treeloom.llm import simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([b" ".join(words)] * bool(words))


def alike(x, y):
    return x == y or len(x & y) / len(x | y) >= 0.8


def labels(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    return closed(sorted(sets), [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if alike(sets[a], sets[b])])


def varied(n=40):
    """Texts, each with copies of which a few words differ."""
    r = random.Random(7)
    rows = []
    for i in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([6, 9, 40, 200, 400]))]
        for k in range(4):
            rows.append((i * 10 + k, " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[r.randrange(len(words))] = f"w{r.randrange(5000)}"
    return rows


def test_stage_finds_all_alike(spark):
    rows = [(r[0], r[1]) for r in made() if r[0] is not None] + [(i + 10_000, t) for i, t in varied()]
    want = labels(dict(rows))
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)
    got = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()
    assert {r.doc_id for r in got} == set(want.values())
    # most of these pairs differ in more than the trie join's three bits
    fp = {i: simhash.fingerprint(t, 5) for i, t in rows}
    linked = closed(sorted(fp), [(a, b) for a, b in itertools.combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
    assert len(set(want.values())) < len(set(linked.values())) - 20


def test_sets_join_through_pairs():
    r = random.Random(3)
    for _ in range(60):
        base = [r.sample(range(60), r.randint(1, 25)) for _ in range(3)]
        made_ = {frozenset(x for x in [*r.choice(base), *r.sample(range(60), 2)] if r.random() > 0.06) for _ in range(30)}
        sets = [np.array(sorted(x), np.uint64) for x in sorted(made_, key=sorted) if x]
        want = closed(range(len(sets)), [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if alike(set(sets[a].tolist()), set(sets[b].tolist()))])
        assert simhash.joined(sets, 0.8).tolist() == [want[i] for i in range(len(sets))]
