"""Tables: results against DuckDB, plan shapes, blocks and odd inputs."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from treeloom import catalog
from treeloom.api import Engine
from treeloom.operators import positions as pos

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICKED = ["q_group_shape", "q_equi_join", "q_three_way", "q_correlated", "q_lookup_join", "q_rolling_avg", "q_cummax", "q_enumerate", "q_take_while", "q_patch_wild_if", "q_pivot", "q_two_fors", "q_deep_find", "q_accumulate"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def same(df, duck, sql):
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, (dict(sorted(zip(names, r, strict=True))) for r in rel.fetchall())))
    assert sorted(map(repr, (dict(sorted(r.asDict().items())) for r in df.collect()))) == want


@pytest.mark.parametrize("name", PICKED)
def test_catalogue(spark, duck, name):
    same(catalog.run(name, spark, DATA), duck, catalog.Q[name][1])


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 240


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    e = catalog.engine(spark, DATA)
    p = plan(e.query("$.lineitem.filter(l_quantity > 45).map({l_orderkey})"))
    assert "PushedFilters" in p and "GreaterThan(l_quantity" in p
    assert "l_comment" not in p and "ReadSchema: struct<l_orderkey" in p
    assert "TakeOrderedAndProject" in plan(e.query("$.orders.sort(-o_totalprice).take(3).map({o_orderkey})"))
    p = plan(e.query("$.orders.group_shape(o_orderstatus, {n: @.count(), s: @.sum(o_totalprice)})"))
    assert p.count("HashAggregate") == 2 and "collect_list" not in p
    assert "BroadcastHashJoin" in plan(e.query("$.customer.equi_join($.nation, c_nationkey, n_nationkey)"))
    for name, (text, _, _) in catalog.Q.items():
        if name.startswith(("q_group", "q_roll", "q_sum", "q_equi")):
            assert "Python" not in plan(e.query(text)), name


@pytest.fixture(scope="module")
def numbers(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, float(r.randint(-20, 20))]), r.choice("xyz")) for i in r.sample(range(1000), 300)]
    return rows, spark.createDataFrame(rows, "k long, v double, g string").repartition(5)


@pytest.mark.parametrize("order", ["k", "-k"])
@pytest.mark.parametrize("call", ["rolling_sum(4)", "rolling_avg(3)", "rolling_min(5)", "rolling_max(2)", "lag(3)", "lead(2)", "diff_window()", "pct_change()", "cummax()", "cummin()", "zscore()"])
def test_blocks_give_what_one_array_gives(spark, numbers, monkeypatch, call, order):
    monkeypatch.setattr(pos, "BLOCK", 16)
    rows, df = numbers
    e = Engine(spark).table("t", df, [order])
    got = e.collect(f"$.t.map(v).{call}")
    values = [v for _, v, _ in sorted(rows, reverse=order[0] == "-")]
    one = Engine(spark).document(spark.createDataFrame([(values,)], "v array<double>"))
    want = one.collect(f"$.v.{call}")
    assert len(got) == len(want)
    assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(got, want, strict=True))


def test_positions_of_texts_and_times(spark):
    rows = [(f"{i:03d}" if i % 7 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, i long").withColumn("t", F.timestamp_seconds("i"))
    assert Engine(spark).table("t", df, ["-s", "i"]).collect("$.t.enumerate().map(value.i)")[:3] == [199, 198, 197]
    assert Engine(spark).table("t", df, ["t"]).collect("$.t.map(i).chunk(50).map(@[0])") == [0, 50, 100, 150]


def test_empty_tables(spark):
    e = Engine(spark).table("t", spark.createDataFrame([], "k long, v double, g string"), ["k"])
    for text, want in (("$.t.sum(v)", 0), ("$.t.avg(v)", None), ("$.t.count()", 0), ("$.t.first()", None), ("$.t.map(v).rolling_sum(2)", []), ("$.t.group_by(g)", {}), ("$.t.all(v > 1)", True),
                       ("$.t.any(v > 1)", False), ("$.t.enumerate()", []), ("$.t.map(g).unique()", []), ("$.t.find_index(v > 1)", None), ("$.t.equi_join($.t, k, k)", []), ("$.t.map(v).zscore()", []), ("$.t.map(k).zip($.t.map(k))", [])):
        assert e.collect(text) == want, text


def test_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("null", 2), ("a", 3)], "k string, x long")
    e = Engine(spark).table("l", left, ["x"]).table("r", left.withColumnRenamed("x", "y"), ["y"])
    assert len(e.collect("$.l.equi_join($.r, k, k)")) == 5  # null is the key "null"
    assert e.collect("$.l.count_by(k)") == {"null": 2, "a": 1}
    nums = spark.createDataFrame([(None,), (1.0,), (1.5,)], "k double")
    assert Engine(spark).table("n", nums).collect("$.n.count_by(k)") == {"null": 1, "1": 1, "1.5": 1}


def test_streams(spark, tmp_path):
    from treeloom.streaming import query_stream, windowed
    src = spark.read.parquet(f"{DATA}/events.parquet")
    src.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = query_stream(stream, "$.stream.filter(value > 100).map({event_id, value})")
    out.writeStream.format("memory").queryName("got").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert spark.table("got").count() == src.where("value > 100").count()
    timed = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    win = windowed(timed, "ts", "1 day", "1 hour", ["event_type"], {"n": F.count("*")})
    win.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start().awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == src.count()


def test_sources(spark, tmp_path):
    from treeloom import sources
    df = spark.read.parquet(f"{DATA}/nation.parquet")
    sources.write(df, str(tmp_path / "j"), "json")
    assert sources.read(spark, str(tmp_path / "j"), "json").count() == 25
    assert sources.json_lines(spark, str(tmp_path / "j"), variant=True).count() == 25
    assert Engine(spark).table("n", sources.json_lines(spark, str(tmp_path / "j"))).collect("$.n.map(n_nationkey).max()") == 24


def test_sessions(spark, tmp_path):
    from treeloom.streaming import sessions
    rows = [("a", 0), ("a", 50), ("a", 500), ("b", 10), ("b", 700)]
    spark.createDataFrame(rows, "user string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, s long, ts timestamp").parquet(str(tmp_path / "in"))
    got = sessions(stream, "ts", "10 minutes", "2 minutes", ["user"], {"n": F.count("*")})
    got.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted((r["user"], r["n"]) for r in spark.table("sessions").collect()) == [("a", 3), ("b", 1), ("b", 1)]


def test_tables_from_python(spark):
    from treeloom import sources
    e = Engine(spark).table("t", sources.rows(spark, [{"a": 1, "b": "x"}, {"a": 2, "b": None}]), ["a"])
    assert e.collect("$.t.map({a, b})") == [{"a": 1, "b": "x"}, {"a": 2}]
    assert e.collect("$.t.sum(a)") == 3


ANALYTICS = ["rolling_sum(4)", "rolling_avg(3)", "rolling_min(5)", "rolling_max(2)", "lag(3)", "lead(2)", "diff_window()", "pct_change()", "cummax()", "cummin()", "zscore()"]


def near(got, want):
    return len(got) == len(want) and all((a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(got, want, strict=True))


def brute(call, xs):
    """An analytic of a list, by its definition."""
    name, n = call[:-1].split("(")
    n = int(n or 1)
    some = [x for x in xs if x is not None]
    mean = sum(some) / len(some) if some else None
    sd = (sum((x - mean) ** 2 for x in some) / len(some)) ** 0.5 if some else None
    out = []
    for i, x in enumerate(xs):
        at = lambda j: xs[j] if 0 <= j < len(xs) else None
        part = [v for v in xs[max(i - n + 1, 0):i + 1] if v is not None]
        so_far = [v for v in xs[:i + 1] if v is not None]
        back = at(i - 1)
        if name.startswith("rolling"):
            f = {"sum": sum, "avg": lambda p: sum(p) / len(p) if p else None, "min": lambda p: min(p, default=None), "max": lambda p: max(p, default=None)}[name[8:]]
            out.append(f(part) if i >= n - 1 else None)
        elif name in ("lag", "lead"):
            out.append(at(i - n if name == "lag" else i + n))
        elif name.startswith("cum"):
            out.append((max if name == "cummax" else min)(so_far, default=None))
        elif name == "zscore":
            out.append(None if x is None else (x - mean) / sd if sd else 0.0)
        else:
            out.append(None if x is None or back is None or name == "pct_change" and back == 0 else x - back if name == "diff_window" else (x - back) / back)
    return out


@pytest.mark.parametrize("order", ["k", "-k"])
@pytest.mark.parametrize("call", ANALYTICS)
def test_analytics_of_groups(spark, numbers, call, order):
    rows, df = numbers
    rows = sorted(rows, reverse=order[0] == "-")
    e = Engine(spark).table("t", df, [order])
    text = f"$.t.group_shape(g, {{all: @.map(v).{call}, some: @.filter(k > 300).map(v).{call}, last: @.map(v).{call}.last(), n: @.count(), first: @.first().k, twice: @.map(v).{call}.lag(1)}})"
    got = {r["key"]: r for r in e.query(text).collect()}
    assert set(got) == set("xyz")
    for g, r in got.items():
        mine = [(k, v) for k, v, x in rows if x == g]
        want = brute(call, [v for _, v in mine])
        assert near(r["all"], want) and near([r["last"]], want[-1:]) and near(r["twice"], [None, *want[:-1]])
        assert near(r["some"], brute(call, [v for k, v in mine if k > 300]))
        assert (r["n"], r["first"]) == (len(mine), mine[0][0])
    assert "collect_list" not in plan(e.query(f"$.t.group_shape(g, {{r: @.map(v).{call}.last()}})"))


def test_analytics_of_odd_groups(spark):
    rows = [("a", None, 1), ("a", None, 2), ("b", 5.0, 3), (None, 1.0, 4), (None, 2.0, 4), (None, 3.0, 5), ("c", 7.0, 6)]
    e = Engine(spark).table("t", spark.createDataFrame(rows, "g string, v double, k long"), ["k"]).table("u", spark.createDataFrame([("a",), ("c",), ("d",)], "h string"), ["h"])
    got = e.collect("$.t.group_by(g).transform_values(@.filter(k != 6).map(v).rolling_sum(2))")
    assert got == {"a": [None, 0.0], "b": [None], "null": [None, 3.0, 5.0], "c": []}  # equal places lie by value
    assert e.collect("$.t.group_by(g).transform_values(@.map(v).zscore().last())") == {"a": None, "b": 0.0, "null": pytest.approx(1.5**0.5), "c": 0.0}
    assert e.collect("$.t.group_by(g).transform_values(@.filter(k != 6).map(v).cummax().count())") == {"a": 2, "b": 1, "null": 3, "c": 0}
    assert e.collect("$.u.map(o => $.t.filter(g == o.h).map(v).cummax().last())") == [None, 7.0, None]
    for call in ANALYTICS:  # without an order a group is one array
        assert len(Engine(spark).table("t", spark.createDataFrame(rows[2:3], "g string, v double, k long")).collect(f"$.t.group_by(g).transform_values(@.map(v).{call})")["b"]) == 1


def test_catalogue_group_rolling(spark, duck):
    same(catalog.run("q_group_rolling", spark, DATA), duck, catalog.Q["q_group_rolling"][1])


@pytest.mark.parametrize("call", [*ANALYTICS, "window(3).count()", "chunk(4).count()", "zip(@.map(k)).count()", "unique_by(@).count()"])
def test_an_array_is_made_once(spark, call):
    """Not again for each element, which takes minutes for 20,000."""
    e = Engine(spark).table("t", spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("v"), F.lit("g").alias("g")))
    began = time.time()
    e.collect(f"$.t.group_by(g).transform_values(@.map(v).{call})")
    assert time.time() - began < 20


@pytest.mark.parametrize("call", ANALYTICS)
def test_analytics_of_arrays(spark, call):
    r = random.Random(7)
    for xs in ([], [None], [None, None], [3.0], [0.0, 1.0], [r.choice([None, float(r.randint(-9, 9))]) for _ in range(70)]):
        got = Engine(spark).document(spark.createDataFrame([(xs,)], "v array<double>")).collect(f"$.v.{call}")
        assert near(got, brute(call, xs))
