"""Descending orders of any type with nulls; positions in ranges."""

import datetime as dt
import random
import re

import pytest

from treeloom import catalog
from treeloom.api import Engine
from treeloom.operators import positions as pos

DATA = "/root/testdata/sf0.001"
ROWS = [(1, 10.0, "a", "x"), (2, None, "b", "x"), (3, 30.0, None, "y"), (4, None, "ab", "y"), (5, 5.0, "a", "y")]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark).table("t", spark.createDataFrame(ROWS, "k long, v double, s string, g string").repartition(3), ["k"])


@pytest.mark.parametrize("text,want", [
    ("$.t.sort(-v).map(k)", [3, 1, 5, 2, 4]),
    ("$.t.sort(-v).unique_by(g).map(k)", [3, 1]),
    ("$.t.sort(-v).group_by(g).transform_values(@.first().k)", {"x": 1, "y": 3}),
    ("$.t.sort(-v).group_by(g).transform_values(@.last().k)", {"x": 2, "y": 4}),
    ("$.t.sort(-v).find_index(k == 3)", 0),
    ("$.t.sort(-v).find_index(k == 4)", 4),
    ("$.t.sort(-v).take_while(v > 4).map(k)", [3, 1, 5]),
    ("$.t.sort(-v).drop_while(v > 4).map(k)", [2, 4]),
    ("$.t.sort(-v).map(k).index(2)", 3),
    ("$.t.sort(-v).index_by(g).transform_values(k)", {"x": 2, "y": 4}),
    ("$.t.sort(-v).map({k}).implode(k)", [{"k": [3, 1, 5, 2, 4]}]),
    ("$.t.sort(-v).map(g).unique()", ["y", "x"]),
    ("$.t.sort(-v).map({g, n: \"n\", k}).pivot(g, k)", {"x": 2, "y": 4}),
    ("$.t.sort(-v).group_by(g).transform_values(@.map(k))", {"x": [1, 2], "y": [3, 5, 4]}),
    ("$.t.sort(-v).group_shape(g, {a: @.max_by(g).k, b: @.min_by(g).k})", {"x": {"a": 1, "b": 1}, "y": {"a": 3, "b": 3}}),
    ("$.t.sort(-v).enumerate().map(value.k)", [3, 1, 5, 2, 4]),
    ("$.t.sort(-v).skip(2).map(k)", [5, 2, 4]),
    ("$.t.sort(-s).map(k)", [2, 4, 1, 5, 3]),
    ("$.t.sort(-s).unique_by(g).map(k)", [2, 4]),
    ("$.t.sort(-s).take_while(k != 1).map(k)", [2, 4]),
    ("$.t.sort(-s).find_index(k == 3)", 4),
    ("$.t.sort(-s).group_by(g).transform_values(@.first().k)", {"x": 2, "y": 4}),
    ("$.t.sort(-s).skip(1).map(k)", [4, 1, 5, 3]),
    ("$.t.sort(s).map(k)", [3, 1, 5, 4, 2]),
    ("$.t.sort(s).find_index(k == 2)", 4),
    ("$.t.sort(-s, -k).map(k)", [2, 4, 5, 1, 3]),
    ("$.t.sort(-s, -k).unique_by(s).map(k)", [2, 4, 5, 3]),
    ("$.t.reverse().sort(-v).take_while(k != 4).map(k)", [3, 1, 5])])
def test_descending(engine, text, want):
    assert engine.collect(text) == want


@pytest.mark.parametrize("kind,values", [
    ("boolean", [True, False, None]), ("long", [-(1 << 63), (1 << 63) - 1, 0, None]), ("string", ["", "a", "a\0", "ab", "b", "é", "\U0001f600", None]),
    ("date", [dt.date(1900, 1, 1), dt.date(2020, 1, 1), None]), ("timestamp", [dt.datetime(1960, 1, 1), dt.datetime(2020, 1, 1), None]),
    ("double", [float("nan"), float("inf"), float("-inf"), -1.5, 0.0, None]), ("array<string>", [[], ["a"], ["a", "b"], ["b"], [None], None]),
    ("struct<x:int,y:string>", [(1, "a"), (1, None), (None, "z"), (2, "a"), None]), ("decimal(10,2)", [None, __import__("decimal").Decimal("1.50"), __import__("decimal").Decimal("-2.25")]),
    ("binary", [b"", b"\xff", b"\xff\x00", None])])
def test_places_are_in_the_order_of_sorting(spark, kind, values):
    r = random.Random(2)
    rows = [(i, r.choice(values)) for i in range(40)]
    e = Engine(spark).table("t", spark.createDataFrame(rows, f"k long, v {kind}").repartition(3), ["-v", "k"])
    want = e.collect("$.t.map(k)")
    for i in (0, 13, 39):
        assert e.collect(f"$.t.find_index(k == {want[i]})") == i
    assert e.collect("$.t.reverse().map(k)") == want[::-1]
    assert e.collect(f"$.t.reverse().find_index(k == {want[3]})") == 36


@pytest.mark.parametrize("order,ranges", [(["s"], 7), (["-s"], 7), (["tie", "k"], 7), (["tie", "-s"], 7), (["-v", "k"], 7), (["k"], 1)])
def test_positions_by_ranges(spark, monkeypatch, order, ranges):
    monkeypatch.setattr(pos, "ROWS", 300 // ranges if ranges > 1 else 1000)
    r = random.Random(9)
    rows = [(i, f"Customer#{i:09d}", "same", r.choice([None, 1.0, 2.0])) for i in r.sample(range(10000), 300)]
    e = Engine(spark).table("t", spark.createDataFrame(rows, "k long, s string, tie string, v double").repartition(4), order)
    assert [x["index"] for x in e.collect("$.t.enumerate()")] == list(range(300))
    assert [x["value"]["k"] for x in e.collect("$.t.enumerate()")] == e.collect("$.t.map(k)")
    assert e.collect("$.t.skip(250).map(k)") == e.collect("$.t.map(k)")[250:]
    assert e.collect("$.t.skip(300).map(k)") == []
    assert e.collect("$.t.skip(0).count()") == 300
    assert len(pos.cuts(e.value("$.t")[0]).first()["__cuts"]) >= (ranges - 1) * 0.7


def steps(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("call", ["skip(5)", "enumerate()", "map(c_acctbal).rolling_sum(3)", "map(c_acctbal).lag(1)", "map(c_acctbal).cummax()", "chunk(10)", "pairwise()", "zip($.c)"])
def test_no_step_takes_all_rows(spark, call):
    jobs = spark.sparkContext.statusTracker()
    for order in (["c_name"], ["-c_name"], ["c_mktsegment", "c_custkey"]):
        e = Engine(spark).table("c", spark.read.parquet(f"{DATA}/customer.parquet"), order)
        made = len(jobs.getJobIdsForGroup(None))  # reading a schema is one
        text = steps(e.query(f"$.c.{call}"))
        assert len(jobs.getJobIdsForGroup(None)) == made
        # one partition only after an aggregate of each part: of counts, the
        # sample, and a row for each range or block
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                below = next(x for x in lines[i + 1:] if re.search(r"\w", x))
                assert re.search(r"HashAggregate|ObjectHashAggregate|SortAggregate|Project", below), text
                assert "Sort [" not in below
        assert "GlobalLimit" not in text


def test_catalogue_skip(spark):
    assert catalog.run("q_skip", spark, DATA).count() > 0
