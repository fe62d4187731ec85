"""Paths and whole-tree builtins, expanded over the known shape of a value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import array_of, pick
from .objects import fields
from .values import BOOL, NULL, STRING, C, QueryError, builtin, cast, common, equal, kind, lit, struct_of, truthy, whole


def steps(path: str) -> list:
    """``a.b[0]`` as names and positions."""
    return [int(i) if i else n for n, i in re.findall(r"([^.\[\]]+)(?![^\[]*\])|\[(-?\d+)\]", path)]


def get(c: C, path: list) -> C:
    for s in path:
        if isinstance(s, int):
            if kind(c.t) == "variant":
                c = C(F.try_variant_get(c.col, f"$[{s}]", "variant"), c.t)
            else:
                c = pick(C(whole(c), c.t), F.lit(s)) if kind(c.t) == "array" else NULL
        else:
            c = c.field(s) if kind(c.t) in ("object", "variant") else NULL
    return c


builtin("get_path")(lambda c, a: get(c, steps(a.val(0).lit)))


@builtin("has_path")
def has_path(c, a):
    v = get(c, steps(a.val(0).lit))
    return lit(False) if kind(v.t) == "null" else C(whole(v).isNotNull(), BOOL)


def put(c: C, path: list, value, when=None) -> C:
    """A copy with the value at a path; value is a C, a function of what is
    there, or None to delete. Missing objects are made, arrays not extended.
    Steps: a name, a position, ("wild", predicate or None) or ("deep", name)."""
    if not path:
        new = value(c) if callable(value) else value
        if when is None:
            return new
        t = common([new.t, c.t])
        return C(F.when(when, cast(new, t).col).otherwise(cast(c, t).col), t)
    s, rest = path[0], path[1:]
    if isinstance(s, str):
        if isinstance(c.t, T.MapType):
            if rest or value is None:
                raise QueryError("only a whole entry of a map can be written")
            new = put(C(F.try_element_at(c.col, F.lit(s)), c.t.valueType), [], value, when)
            return C(F.map_concat(F.map_filter(c.col, lambda k, v: k != s), F.create_map(F.lit(s), new.col.cast(c.t.valueType))), c.t)
        own = fields(c) if isinstance(c.t, T.StructType) else {}
        if value is None and not rest:
            if when is not None and s in own:  # the field's shape is fixed: null stands for absent
                return struct_of(own | {s: C(F.when(~when, whole(own[s])), own[s].t)})
            return struct_of({n: v for n, v in own.items() if n != s})
        return struct_of(own | {s: put(own.get(s, NULL), rest, value, when)})
    if isinstance(s, tuple) and s[0] == "deep":
        def down(v):
            if isinstance(v.t, T.StructType):
                out = {}
                for n, x in fields(v).items():
                    x = down(x)
                    if n == s[1]:
                        if value is None and not rest:
                            continue
                        x = put(x, rest, value, when)
                    out[n] = x
                return struct_of(out)
            if isinstance(v.t, T.ArrayType) and isinstance(v.t.elementType, (T.StructType, T.ArrayType)):
                return _each(v, lambda x, i: down(x))
            return v

        return down(c)
    if not isinstance(c.t, T.ArrayType):
        if isinstance(s, tuple):
            raise QueryError("[*] needs an array")
        return c
    c = C(whole(c), c.t)
    if isinstance(s, tuple):
        test = s[1]
        if value is None and not rest:
            return C(F.filter(c.col, lambda x: ~(truthy(test(C(x, c.t.elementType))) if test else F.lit(True))), c.t)
        return _each(c, lambda x, i: put(x, rest, value, when) if test is None else _choose(truthy(test(x)), put(x, rest, value, when), x))
    n = F.size(c.col)
    at = F.when(s < 0, n + s).otherwise(s) if not isinstance(s, int) else (F.lit(s) if s >= 0 else n + s)
    if value is None and not rest:
        return C(F.filter(c.col, lambda x, i: i != at), c.t)
    return _each(c, lambda x, i: _choose(i == at, put(x, rest, value, when), x))


def _choose(test, a: C, b: C) -> C:
    t = common([a.t, b.t])
    return C(F.when(test, cast(a, t).col).otherwise(cast(b, t).col), t)


def _each(c: C, f) -> C:
    seen = []

    def run(x, i):
        got = f(C(x, c.t.elementType), i)
        seen.append(got.t)
        return whole(got)

    col = F.transform(whole(c), run)
    return C(col, T.ArrayType(seen[0]))


builtin("set_path")(lambda c, a: put(c, steps(a.val(0).lit), a.val(1)))
builtin("del_path")(lambda c, a: put(c, steps(a.val(0).lit), None))


@builtin("del_paths")
def del_paths(c, a):
    for i in range(a.count):
        c = put(c, steps(a.val(i).lit), None)
    return c


def _walk(c: C, f, before: bool) -> C:
    if before:
        c = f(c)
    if isinstance(c.t, T.StructType):
        c = struct_of({n: _walk(v, f, before) for n, v in fields(c).items()})
    elif isinstance(c.t, T.ArrayType):
        c = _each(c, lambda x, i: _walk(x, f, before))
    return c if before else f(c)


builtin("walk")(lambda c, a: _walk(c, a.fn(0), False))
builtin("walk_pre")(lambda c, a: _walk(c, a.fn(0), True))

UNROLLED = 24


@builtin("rec")
def rec(c, a):
    """Steps until a value repeats, at most UNROLLED of them in a plan; a value
    that has not settled by then fails the query."""
    f, x = a.fn(0), c
    if kind(c.t) in ("array", "object"):
        raise QueryError("rec needs a scalar")
    box = F.struct(whole(x).alias("v"), F.lit(False).alias("done"))
    t = x.t

    def step(s, i):
        new = whole(f(C(s.getField("v"), t))).cast(t)
        return F.when(s.getField("done"), s).otherwise(F.struct(new.alias("v"), equal(C(new, t), C(s.getField("v"), t)).alias("done")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(10_000)), box, step)
    return C(F.when(end.getField("done"), end.getField("v")).otherwise(F.raise_error(F.lit("rec did not settle")).cast(t)), t)


def descend(c: C, path: str = "$", every: bool = False):
    """(path, value, through) of the nodes below a value, own one first. A node
    inside an array is a function of the elements on the way: through lists
    the arrays to go through."""
    yield path, c
    if isinstance(c.t, T.StructType):
        for n, v in fields(c).items():
            yield from descend(v, f"{path}.{n}")


#: Levels of a value without a known shape that a descent goes down.
LEVELS = 64


def inside(v: Column) -> Column:
    """The nodes of a variant, its own first, pre-order, as {at, path, v}: one
    level after another, sorted by their places at the end. A value of more
    than LEVELS levels fails the query."""
    node = lambda at, path, x: F.struct(at.alias("at"), path.alias("path"), x.alias("v"))
    t = "array<struct<at:array<int>,path:string,v:variant>>"

    def below(n):
        at, path, x = n.getField("at"), n.getField("path"), n.getField("v")
        items = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y, i: node(F.array_append(at, i), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), y))
        pairs = F.transform(F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")),
                            lambda e, i: node(F.array_append(at, i), F.concat(path, F.lit("."), e.getField("key")), e.getField("value")))
        return F.coalesce(items, pairs, F.array().cast(t))

    start = F.struct(F.array().cast(t).alias("all"), F.array(node(F.array().cast("array<int>"), F.lit(""), v)).alias("last"))
    step = lambda s, i: F.struct(F.concat(s.getField("all"), s.getField("last")).alias("all"), F.flatten(F.transform(s.getField("last"), below)).alias("last"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, step)
    found = F.array_sort(end.getField("all"), lambda a, b: F.when(a.getField("at") < b.getField("at"), -1).when(a.getField("at") > b.getField("at"), 1).otherwise(0))
    deep = F.raise_error(F.lit(f"a value of more than {LEVELS} levels")).cast(t)
    return F.when(v.isNull(), F.array().cast(t)).when(F.size(end.getField("last")) > 0, deep).otherwise(found)


def is_list(x: C) -> Column:
    """Whether a variant is an array."""
    return F.coalesce(F.schema_of_variant(x.col).startswith("ARRAY"), F.lit(False))


def nodes(c: C, test, path=None) -> C:
    """All nodes of a tree for which ``test`` gives a predicate, pre-order, as
    one array; with ``path`` as {path, value} structs."""
    found: list[C] = []
    t_out: list = []

    def shape(x):
        t = test(x, True)
        if t is not None:
            t_out.append(x.t)
        if isinstance(x.t, T.StructType):
            for n in x.t.names:
                shape(C(None, x.t[n].dataType))
        elif isinstance(x.t, T.ArrayType):
            shape(C(None, x.t.elementType))

    shape(C(None, c.t))
    if not t_out:
        return C(F.array(), T.ArrayType(T.NullType()))
    t = common(t_out)
    out_t = T.StructType([T.StructField("path", STRING), T.StructField("value", t)]) if path is not None else t

    def walk(x: C, at):
        parts = []
        if kind(x.t) == "variant":
            if test(x, True) is None:
                return parts
            item = lambda n: cast(C(n.getField("v"), x.t), t).col
            if at is not None:
                item = lambda n: F.struct(F.concat(at, n.getField("path")).alias("path"), cast(C(n.getField("v"), x.t), t).col.alias("value"))
            return [F.transform(F.filter(inside(x.col), lambda n: test(C(n.getField("v"), x.t), False)), item)]
        ok = test(x, False)
        if ok is not None:
            item = cast(x, t).col
            if at is not None:
                item = F.struct(at.alias("path"), item.alias("value"))
            parts.append(F.when(ok, F.array(item)).otherwise(F.array().cast(T.ArrayType(out_t))))
        if isinstance(x.t, T.StructType):
            for n, v in fields(x).items():
                parts += walk(v, None if at is None else F.concat(at, F.lit(f".{n}")))
        elif isinstance(x.t, T.ArrayType):
            inner = lambda y, i: joined(walk(C(y, x.t.elementType), None if at is None else F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
            if any_below(C(None, x.t.elementType)):
                parts.append(F.coalesce(F.flatten(F.transform(whole(x), inner)), F.array().cast(T.ArrayType(out_t))))
        return parts

    def any_below(x):
        if test(x, True) is not None:
            return True
        if isinstance(x.t, T.StructType):
            return any(any_below(C(None, f.dataType)) for f in x.t.fields)
        return isinstance(x.t, T.ArrayType) and any_below(C(None, x.t.elementType))

    def joined(parts):
        return F.concat(*parts) if parts else F.array().cast(T.ArrayType(out_t))

    del found
    return C(joined(walk(c, F.lit(path) if path is not None else None)), T.ArrayType(out_t))


def tried(fns, x: C, dry: bool):
    """A predicate over a node; None if it can hold for no value of its shape."""
    if dry:
        return True
    got = F.lit(True)
    for f in fns:
        got = got & truthy(f(x))
    return got


@builtin("deep_find")
def deep_find(c, a):
    fns = [a.fn(i) for i in range(a.count)]
    needs = a.fields()

    def test(x, dry):
        if kind(x.t) == "variant":
            return True if dry else ~is_list(x) & tried(fns, x, dry)
        if kind(x.t) == "array" or (needs and not (isinstance(x.t, T.StructType) and needs <= set(x.t.names))):
            return None
        return tried(fns, x, dry)

    return nodes(c, test)


@builtin("deep_shape")
def deep_shape(c, a):
    names = set(a.entry_names(0))

    def held(x, dry):
        if dry:
            return True
        got = F.lit(True)
        for n in sorted(names):
            got = got & x.field(n).col.isNotNull()
        return got

    return nodes(c, lambda x, dry: held(x, dry) if kind(x.t) == "variant" else (True if dry else whole(x).isNotNull() if x.parts is None else F.lit(True)) if isinstance(x.t, T.StructType) and names <= set(x.t.names) else None)


@builtin("deep_like")
def deep_like(c, a):
    want = a.entries(0)

    def test(x, dry):
        open_ = kind(x.t) == "variant"
        if not open_ and not (isinstance(x.t, T.StructType) and set(want) <= set(x.t.names)):
            return None
        if dry:
            return True
        got = F.lit(True)
        for n, v in want.items():
            got = got & equal(x.field(n), v)
            if open_:
                got = got & x.field(n).col.isNotNull()
        return got

    return nodes(c, test)


@builtin("trace_path")
def trace_path(c, a):
    f = a.fn(0)
    return nodes(c, lambda x, dry: True if dry else truthy(f(x)), "$")


def named(c: C, name: str | None) -> C:
    """All values stored under a name, or all nodes but arrays."""
    if name is None:
        return nodes(c, lambda x, dry: None if kind(x.t) == "array" else True if dry else ~is_list(x) if kind(x.t) == "variant" else F.lit(True))

    def gather(x: C) -> list[C]:
        out = []
        if kind(x.t) == "variant":
            here = lambda n: C(n.getField("v"), x.t).field(name).col
            return [C(F.transform(F.filter(inside(x.col), lambda n: here(n).isNotNull()), here), T.ArrayType(x.t))]
        if isinstance(x.t, T.StructType):
            if name in x.t.names:
                v = x.field(name)
                out.append(array_of([v]))
            for n, v in fields(x).items():
                out += gather(v)
        elif isinstance(x.t, T.ArrayType):
            shape = gather(C(F.lit(None).cast(x.t.elementType), x.t.elementType))
            if shape:
                t = T.ArrayType(common([s.t.elementType for s in shape]))
                inner = lambda y: F.concat(*[cast(s, t).col for s in gather(C(y, x.t.elementType))])
                out.append(C(F.coalesce(F.flatten(F.transform(whole(x), inner)), F.array().cast(t)), t))
        return out

    found = gather(c)
    if not found:
        return C(F.array(), T.ArrayType(T.NullType()))
    t = T.ArrayType(common([s.t.elementType for s in found]))
    return C(F.concat(*[cast(s, t).col for s in found]), t)
