"""Line dedup in packed rows: few rows are shuffled, groups come out whole, and
sets that share half of a name are told apart without other names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from treeloom.llm import line_dedup


def left(rows, threshold=0.8):
    seen, want = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.lower().split())
            if not words or not any(len(words & w) >= threshold * len(words | w) - 1e-9 for w in seen):
                kept.append(line)
            seen += [words] if words else []
        want[i] = "\n".join(kept)
    return want


def result(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()}


@pytest.fixture
def by_value():
    # workers import the module anew, so its functions are sent by value
    cloudpickle.register_pickle_by_value(line_dedup)
    yield
    cloudpickle.unregister_pickle_by_value(line_dedup)


def test_fewer_rows_than_lines_are_shuffled_to_meet(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, "\n".join(" ".join(f"w{r.randrange(5000)}" for _ in range(40)) for _ in range(10))) for i in range(200)]
    rows.append((200, rows[0][1].split("\n")[0] + " more"))
    kind, moved = type(spark.range(0)), []
    real = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: (moved.append(self.count()), real(self, *a))[1])
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert got == dict(rows) | {200: ""}
    assert moved and max(moved) < 2000


@pytest.mark.parametrize("hot", [4096, 2])
def test_any_size_of_groups(spark, monkeypatch, by_value, hot):
    for name, n in (("WORDS", 8), ("ROWS", 3), ("PACKED", 20), ("HELD", 5), ("SECTION", 50), ("HOT", hot), ("TRIED", 1)):
        monkeypatch.setattr(line_dedup, name, n)
    r = random.Random(hot)
    rows = [(i, "\n".join(" ".join(r.choice("abcdefghi") * r.randint(1, 2) for _ in range(r.choice([0, 1, 3, 6, 12]))) for _ in range(r.randint(1, 4)))) for i in range(60)]
    assert result(spark, rows) == left(rows)


def test_sets_of_half_a_name(spark, monkeypatch, by_value):
    rows = [(1, "one two three four five\nsix"), (2, "four five six"), (3, "three two one five four\nsix Six"), (4, "five six four\nfive four three two one zero")]
    real, begun = line_dedup._sums, line_dedup.line_matches
    seeds = []

    def half(words, start, size, seed):
        out = real(words, start, size, seed)
        out[0] = 7
        return out

    monkeypatch.setattr(line_dedup, "_sums", half)
    monkeypatch.setattr(line_dedup, "line_matches", lambda *a: (seeds.append(a[4:]), begun(*a))[1])
    assert result(spark, rows) == left(rows)
    assert seeds == [()]


def test_packed_groups_come_back_whole():
    r = np.random.RandomState(2)
    rows = np.zeros(1000, line_dedup.LINE)
    rows["d1"], rows["words"] = r.randint(0, 50, 1000), r.randint(0, 4, 1000)
    flat = np.repeat(rows["d1"].astype(np.uint32), rows["words"])
    group = (rows["d1"] * 7 % 13).astype(np.uint8)
    packed = [line_dedup._pack(group[a:a + 250], rows[a:a + 250], rows["words"][a:a + 250].astype(np.int64), flat[rows["words"][:a].sum():rows["words"][:a + 250].sum()]) for a in range(0, 1000, 250)]
    table = pa.Table.from_batches(packed).sort_by("part").combine_chunks()
    for most in (1, 120, 10**6):
        got = list(line_dedup._whole(table.to_batches(max_chunksize=5), line_dedup.LINE, most))
        assert sum(len(x) for x, _ in got) == 1000
        seen = [set((x["d1"] * 7 % 13).tolist()) for x, _ in got]
        assert sum(map(len, seen)) == 13
        for x, values in got:
            assert (np.repeat(x["d1"], x["words"]) == values).all()
    assert list(line_dedup._whole([], line_dedup.LINE, 1)) == []
