"""Line dedup of lines of one to four words."""

import random

import pytest

from treeloom.llm import line_dedup


@pytest.mark.parametrize("hot", [2048, 1])
def test_short_lines_go(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(6)
    rows = [(i, "\n".join(" ".join(r.choice("abcdef") for _ in range(r.randint(0, 6))) for _ in range(4))) for i in range(60)]
    rows += [(100, "All rights reserved.\n\nmenu"), (101, "ALL rights reserved.\n\nmenu menu"), (102, "one two three four five"), (103, "four three two one")]
    seen, want = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.lower().split())
            if not words or not any(len(words & w) / len(words | w) >= 0.8 for w in seen):
                kept.append(line)
            seen += [words] if words else []
        want[i] = "\n".join(kept)
    assert (want[101], want[103]) == ("", "")
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in got} == want
