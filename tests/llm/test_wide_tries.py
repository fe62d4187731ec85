"""The pipeline's near-duplicate stage: links of the trie join of fingerprints
alone, before sets are looked at, against all pairs of shingle sets."""

import itertools
import random

import numpy as np
from test_llm import closed
from test_whole_groups import alike, shingles, varied

from treeloom.llm import simhash


def edges(n=60):
    """Texts of 4 to 300 shingles with one that shares just 0.8 of them, or
    next to it."""
    r = random.Random(11)
    rows = []
    for i in range(n):
        words = [f"v{r.randrange(10**6)}" for _ in range(r.choice([9, 13, 14, 24, 54, 304]))]
        m = len(words) - 4
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 4 + -(-4 * m // 5)]))]
    return rows


def test_trie_links_join_all_alike(spark):
    words, budget = simhash.width_for(0.8, 3e-6)
    for rows in (edges(), varied()):
        sets = {i: simhash._set(t, 5) for i, t in rows}
        texts = {i: shingles(t) for i, t in rows}
        fps = {i: simhash.wide(h, 1 + words * (2 if len(h) <= simhash.FEW else 1)) for i, h in sets.items() if len(h) >= 4}
        df = spark.createDataFrame([(f.tolist(),) for f in fps.values()], "fp array<long>").repartition(3)
        links = [(r.a, r.b) for r in simhash.wide_links(df, budget).collect()]
        name = {i: int(f[0]) for i, f in fps.items()}
        group = closed(sorted(set(name.values())), links)
        pairs = [(i, j) for i, j in itertools.combinations(sorted(fps), 2) if alike(texts[i], texts[j])]
        assert len(pairs) > 40
        assert all(group[name[i]] == group[name[j]] for i, j in pairs)
        # and unlike texts are kept apart
        strange = [(i, j) for i, j in itertools.combinations(sorted(fps), 2) if not texts[i] & texts[j]]
        assert sum(group[name[i]] == group[name[j]] for i, j in strange) == 0


def test_leaves_of_many_values_give_the_same_pairs():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    vals = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)]]))
    name = r.integers(0, 4, len(vals), dtype=np.uint64)
    want = {(i, j) for i, j in itertools.combinations(range(len(vals)), 2)
            if int(vals[i] ^ vals[j]) >> 60 == 0 and int(vals[i] ^ vals[j]).bit_count() + int(name[i] ^ name[j]).bit_count() <= 3}
    for size in (1, 2, 16):
        got = [(int(a), int(b)) for x, y in simhash.trie_pairs(vals, 4, 3, name, size) for a, b in zip(x, y, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
