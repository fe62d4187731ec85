"""The line join against brute force at several thresholds; where rows meet
does not change what matches."""

import random

import numpy as np
import pyarrow as pa
import pytest

from treeloom.llm import common, line_dedup


def left(rows, threshold):
    seen, want = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.encode().lower().split())
            if not words or not any(len(words & w) >= threshold * len(words | w) - 1e-9 for w in seen):
                kept.append(line)
            seen += [words] if words else []
        want[i] = "\n".join(kept)
    return want


def texts(seed):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(n))
    rows = [(i, "\n".join(say(r.choice([0, 1, 2, 3, 5, 9, 20])) for _ in range(r.randint(1, 4)))) for i in range(50)]
    base = [f"w{k}" for k in range(40)]
    rows += [(100 + i, " ".join(r.sample(base, 36)) + f" own{i}") for i in range(30)]
    rows += [(200, "Same Line here\nsame line HERE"), (201, "x" * 400 + " " + "é" * 300), (202, "X" * 400 + " " + "é" * 300)]
    return rows


@pytest.mark.parametrize("threshold,hot,tried", [(0.3, 1, 1), (0.3, 4096, 4), (0.5, 3, 4), (0.8, 1, 1), (1.0, 4096, 4)])
def test_any_threshold(spark, monkeypatch, threshold, hot, tried):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "TRIED", tried)
    if tried == 1:  # nothing is small enough to send
        monkeypatch.setattr(common, "BROADCAST", -1)
    rows = texts(int(threshold * 10))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold).collect()
    assert {x.doc_id: x.text for x in got} == left(rows, threshold)


def test_ten_short_lines_whatever_is_hot(spark, monkeypatch):
    rows = [(i, " ".join(["all", *[f"{w}{i}" for w in "ab"[:i % 3]]])) for i in range(10)]
    want = left(rows, 0.3)
    assert sum(not t for t in want.values()) == 9
    for hot in (10**9, 1):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 0.3).collect()} == want


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    rows = [(1, "one two three"), (2, "four five six"), (3, "three two one")]
    real = line_dedup._sums

    def same(words, start, size, seed):
        out = real(words, start, size, seed)
        if seed == 1:
            out[:2] = 7
        return out

    monkeypatch.setattr(line_dedup, "_sums", same)
    # workers import the module anew, so its functions are sent by value
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(line_dedup)
    try:
        got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(line_dedup)
    assert got == {1: "one two three", 2: "four five six", 3: ""}


def test_refused():
    for threshold, least in ((0, 1), (1.1, 1), (0.8, 0)):
        with pytest.raises(ValueError):
            line_dedup.dedup_lines(None, threshold, least)


def test_words_lines_and_hashes():
    r = random.Random(3)
    said = ["", "a b\nA  b\n", "\n", "é È\tq\n\n zz", " lead", "trail ", "W" * 300 + " " + "v" * 257 + " " + "V" * 256, "abcdefghi ABCDEFGH abcdefgh abcdefghijklmnopqrstuvwxyz"]
    said += ["".join(r.choice("abAB \n\tcd") for _ in range(r.randint(0, 60))) for _ in range(200)]
    want = [(i, k, line) for i, t in enumerate(said) for k, line in enumerate(t.encode().split(b"\n"))]
    for at_once in (1, 20, 10**6):
        seen, got = {}, []
        for text, number, raw, opens, stops, counts, hashes in line_dedup._lines(pa.array(said), at_once):
            at = 0
            for t, k, a, z, n in zip(text, number, opens, stops, counts, strict=True):
                line = raw.tobytes()[a:z]
                assert len(line.split()) == n
                assert all(seen.setdefault(w, h) == h for w, h in zip(line.lower().split(), hashes[at:at + n], strict=True))
                at += n
                got.append((t, k, line))
        assert got == want
        assert len(set(seen.values())) == len(seen)
    assert [len(x) for x in line_dedup._lines(pa.array([], pa.string()))] == []
    assert all(len(x[-1]) == 0 for x in line_dedup._lines(pa.array(["", ""])))


def test_names_hold_what_was_put_in(spark):
    ids = np.random.RandomState(1).randint(-(1 << 62), 1 << 62, 5000)
    names = line_dedup.Names(spark.createDataFrame([(int(i),) for i in ids[:2500]], "id long").repartition(5))
    assert names.have(ids[:2500]).all()
    assert names.have(ids[2500:]).mean() < 0.05
