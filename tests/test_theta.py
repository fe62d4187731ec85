"""Correlated filters by other tests than equality, against Python."""

import operator
import random

import pytest

from treeloom.api import Engine
from treeloom.operators import positions as pos

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(6)
    xs = [(i, r.choice([None, *range(20)]), r.choice("abc")) for i in range(60)]
    ys = [(i, r.choice([None, *range(20)]), r.choice("abc"), float(r.randint(-5, 5))) for i in range(150)]
    e = Engine(spark).table("xs", spark.createDataFrame(xs, "i long, x long, g string").repartition(3), ["i"])
    return e.table("ys", spark.createDataFrame(ys, "j long, y long, h string, w double").repartition(3), ["j"]), xs, ys


@pytest.mark.parametrize("op,rows", [("<", 50), (">=", 1 << 16)])
def test_one_comparison_runs_along_the_order(tables, monkeypatch, op, rows):
    monkeypatch.setattr(pos, "ROWS", rows)
    e, xs, ys = tables
    got = e.collect(f"$.xs.map(r => {{i: r.i, n: $.ys.filter(y {op} r.x).count(), s: $.ys.filter(r.x {dict(zip('<>', '><', strict=True))[op[0]] + op[1:]} y).sum(w), m: $.ys.filter(y {op} r.x).min(w)}})")
    for row, (i, x, _) in zip(got, xs, strict=True):
        some = [w for _, y, _, w in ys if x is not None and y is not None and OPS[op](y, x)]
        assert (row["i"], row["n"], row["s"], row["m"]) == (i, len(some), sum(some), min(some, default=None))
    assert "CartesianProduct" not in e.query(f"$.xs.map(r => $.ys.filter(y {op} r.x).count())")._jdf.queryExecution().executedPlan().toString()


def test_other_tests_join(tables):
    e, xs, ys = tables
    got = e.collect("$.xs.map(r => {i: r.i, n: $.ys.filter(h == r.g and y > r.x).count(), f: $.ys.filter(y != r.x and h == r.g).first().j, any: $.ys.filter(y < r.x, h != r.g).any(w > 4)})")
    less = lambda a, b: a is not None and b is not None and a < b
    for row, (i, x, g) in zip(got, xs, strict=True):
        assert row["i"] == i
        assert row["n"] == sum(h == g and less(x, y) for _, y, h, _ in ys)
        assert row["f"] == next((j for j, y, h, _ in ys if y != x and h == g), None)
        assert row["any"] == any(less(y, x) and h != g and w > 4 for _, y, h, w in ys)


def test_rows_and_comprehensions(tables):
    e, xs, ys = tables
    got = e.collect("$.xs.filter(i < 5).map(r => $.ys.filter(y > r.x).map(j))")
    assert got == [[j for j, y, _, _ in ys if x is not None and y is not None and y > x] for i, x, _ in xs if i < 5]
    flat = e.collect("[a.i * 1000 + b.j for a in $.xs for b in $.ys.filter(y > a.x and h == a.g)]")
    assert sorted(flat) == sorted(i * 1000 + j for i, x, g in xs for j, y, h, _ in ys if x is not None and y is not None and y > x and h == g)


def test_lookups_of_one_key_are_one_aggregate(tables):
    e, xs, ys = tables
    text = "$.xs.map(r => {n: $.ys.filter(h == r.g).count(), s: $.ys.filter(h == r.g).sum(w), m: $.ys.filter(h == r.g).max(y)})"
    plan = e.query(text)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
    for row, (_, _, g) in zip(e.collect(text), xs, strict=True):
        some = [(y, w) for _, y, h, w in ys if h == g]
        assert (row["n"], row["s"], row["m"]) == (len(some), sum(w for _, w in some), max(y for y, _ in some if y is not None))
