"""Builtins on objects: structs with known fields, maps and variants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import array_of
from .values import BOOL, NULL, STRING, C, QueryError, builtin, cast, common, display, dropped, hof, kind, lit, struct_of, truthy, whole


def fields(c: C) -> dict[str, C]:
    return {n: c.field(n) for n in c.t.names}


def as_map(c: C) -> C:
    """An object as a map; values of several types become one that holds all."""
    if isinstance(c.t, T.MapType):
        return c
    if kind(c.t) == "variant":
        return C(F.try_variant_get(c.col, "$", "map<string,variant>"), T.MapType(STRING, T.VariantType()))
    t = common([f.dataType for f in c.t.fields])
    if isinstance(t, T.NullType):
        t = STRING
    parts = [x for n, v in fields(c).items() for x in (F.lit(n), cast(v, t).col)]
    gone = [f.name for f in c.t.fields if dropped(f)]
    m = F.create_map(*parts)
    return C(F.map_filter(m, lambda k, v: ~(k.isin(gone) & v.isNull())) if gone else m, T.MapType(STRING, t))


def obj(*names, other=None):
    def add(f):
        def run(c, a):
            if kind(c.t) not in ("object", "variant"):
                return c if other is None else other(c, a)
            return f(c, a)

        builtin(*names)(run)
        return f

    return add


def none(t):
    return lambda c, a: C(F.array().cast(T.ArrayType(t)), T.ArrayType(t))


@obj("keys", other=none(STRING))
def keys(c, a):
    if isinstance(c.t, T.StructType):
        if any(map(dropped, c.t.fields)):
            return C(F.array_compact(F.array(*[F.when(whole(c.field(f.name)).isNotNull(), f.name) if dropped(f) else F.lit(f.name) for f in c.t.fields])), T.ArrayType(STRING))
        return array_of([lit(n) for n in c.t.names])
    return C(F.map_keys(as_map(c).col), T.ArrayType(STRING))


@obj("values", other=none(STRING))
def values(c, a):
    if isinstance(c.t, T.StructType) and not any(map(dropped, c.t.fields)):
        return array_of(list(fields(c).values()))
    m = as_map(c)
    return C(F.map_values(m.col), T.ArrayType(m.t.valueType))


@obj("entries", other=none(T.ArrayType(STRING)))
def entries(c, a):
    m = as_map(c)
    t = common([STRING, m.t.valueType])
    pair = lambda e: F.array(cast(C(e.getField("key"), STRING), t).col, cast(C(e.getField("value"), m.t.valueType), t).col)
    return C(F.transform(F.map_entries(m.col), pair), T.ArrayType(T.ArrayType(t)))


@obj("to_pairs")
def to_pairs(c, a):
    m = as_map(c)
    t = T.StructType([T.StructField("key", STRING), T.StructField("val", m.t.valueType)])
    return C(F.transform(F.map_entries(m.col), lambda e: F.struct(e.getField("key").alias("key"), e.getField("value").alias("val"))), T.ArrayType(t))


@obj("invert")
def invert(c, a):
    from .arrays import _last_wins
    m = as_map(c)
    pairs = F.transform(F.map_entries(m.col), lambda e: F.struct(display(C(e.getField("value"), m.t.valueType)).alias("key"), e.getField("key").alias("value")))
    return _last_wins(pairs, STRING)


def each(f):
    """A builtin of objects, on an array of them used on each."""
    def run(c, a):
        if isinstance(c.t, T.ArrayType) and isinstance(c.t.elementType, (T.StructType, T.MapType)):
            col, t = hof(F.transform, c, lambda x: f(x, a))
            return C(col, T.ArrayType(t))
        return f(c, a) if kind(c.t) in ("object", "variant") else c

    return run


def picked(c: C, specs: list[tuple[str, str]]) -> dict[str, C]:
    out = {}
    for alias, path in specs:
        v, first = c, path.split(".")[0]
        for step in path.split("."):
            v = v.field(step)
        if isinstance(c.t, T.StructType) and kind(v.t) == "null":
            continue
        out[first if alias == path else alias] = v
    return out


builtin("pick")(each(lambda c, a: struct_of(picked(c, a.names()))))


def _omit(c, a):
    gone = {p for _, p in a.names()}
    if isinstance(c.t, T.MapType):
        return C(F.map_filter(c.col, lambda k, v: ~k.isin(list(gone))), c.t)
    return struct_of({n: v for n, v in fields(c).items() if n not in gone})


builtin("omit")(each(_omit))


def merged(a: C, b: C, shape: bool = False, deep: bool = False, lists: bool = False):
    """Fields of both, the right one's where both have a name. ``shape`` gives
    the type alone; ``deep`` merges objects in objects, ``lists`` joins arrays."""
    if shape:
        return T.StructType([T.StructField(n, (b.t[n] if n in b.t.names else a.t[n]).dataType) for n in dict.fromkeys([*a.t.names, *b.t.names])])
    if not (isinstance(a.t, T.StructType) and isinstance(b.t, T.StructType)):
        x, y = as_map(a), as_map(b)
        t = common([x.t.valueType, y.t.valueType])
        x, y = (F.transform_values(m.col, lambda k, v, m=m: cast(C(v, m.t.valueType), t).col) for m in (x, y))
        return C(F.map_concat(F.map_filter(x, lambda k, v: ~F.map_contains_key(y, k)), y), T.MapType(STRING, t))
    out = {}
    for n in dict.fromkeys([*a.t.names, *b.t.names]):
        if n in a.t.names and n in b.t.names and deep:
            p, q = a.field(n), b.field(n)
            if isinstance(p.t, T.StructType) and isinstance(q.t, T.StructType):
                out[n] = merged(p, q, deep=True, lists=lists)
                continue
            if lists and kind(p.t) == kind(q.t) == "array":
                t = T.ArrayType(common([p.t.elementType, q.t.elementType]))
                out[n] = C(F.concat(cast(p, t).col, cast(q, t).col), t)
                continue
        out[n] = b.field(n) if n in b.t.names else a.field(n)
    return struct_of(out)


obj("merge")(lambda c, a: merged(c, a.val(0)))
obj("deep_merge")(lambda c, a: merged(c, a.val(0), deep=True))


@obj("defaults")
def defaults(c, a):
    from .numbers import coalesce
    o = a.val(0)
    if not (isinstance(c.t, T.StructType) and isinstance(o.t, T.StructType)):
        x, y = as_map(c), as_map(o)
        x = F.map_filter(x.col, lambda k, v: v.isNotNull())
        return C(F.map_concat(F.map_filter(y.col, lambda k, v: ~F.map_contains_key(x, k)), x), y.t)
    return struct_of({n: coalesce([c.field(n), o.field(n)]) if n in o.t.names else c.field(n) for n in dict.fromkeys([*c.t.names, *o.t.names])})


@obj("rename")
def rename(c, a):
    to = {n: v.lit for n, v in fields(a.val(0)).items()}
    if isinstance(c.t, T.MapType):
        pairs = F.create_map(*[x for k, v in to.items() for x in (F.lit(k), F.lit(v))])
        return C(F.transform_keys(c.col, lambda k, v: F.coalesce(F.try_element_at(pairs, k), k)), c.t)
    out = {n: v for n, v in fields(c).items() if not isinstance(to.get(n), str)}
    return struct_of(out | {to[n]: v for n, v in fields(c).items() if isinstance(to.get(n), str)})


@obj("transform_keys")
def transform_keys(c, a):
    f = a.fn(0)
    m = as_map(c)
    from .arrays import _last_wins
    return _last_wins(F.transform(F.map_entries(m.col), lambda e: F.struct(display(f(C(e.getField("key"), STRING))).alias("key"), e.getField("value").alias("value"))), m.t.valueType)


@obj("transform_values")
def transform_values(c, a):
    f = a.fn(0)
    if isinstance(c.t, T.StructType):
        return struct_of({n: f(v) for n, v in fields(c).items()})
    m, seen = as_map(c), []

    def run(k, v):
        got = f(C(v, m.t.valueType))
        seen.append(got.t)
        return whole(got)

    col = F.transform_values(m.col, run)
    return C(col, T.MapType(STRING, seen[0]))


@obj("filter_keys")
def filter_keys(c, a):
    f, m = a.fn(0), as_map(c)
    return C(F.map_filter(m.col, lambda k, v: truthy(f(C(k, STRING)))), m.t)


@obj("filter_values")
def filter_values(c, a):
    f, m = a.fn(0), as_map(c)
    return C(F.map_filter(m.col, lambda k, v: truthy(f(C(v, m.t.valueType)))), m.t)


@obj("has")
def has(c, a):
    from .arrays import includes
    return includes(c, a)


@builtin("missing")
def missing(c, a):
    v = c
    for step in str(a.val(0).lit).split("."):
        v = v.field(step) if kind(v.t) in ("object", "variant") else NULL
    if kind(v.t) == "null":
        return lit(True)
    gone = whole(v).isNull()
    return C(gone | F.coalesce(F.is_variant_null(v.col), F.lit(False)) if kind(v.t) == "variant" else gone, BOOL)


def nested(flat: dict[str, C], sep: str) -> C:
    tree: dict = {}
    for name, v in flat.items():
        at, steps = tree, name.split(sep)
        for s in steps[:-1]:
            at = at.setdefault(s, {}) if isinstance(at, dict) else at
            if not isinstance(at, dict):
                break
        if isinstance(at, dict):
            at[steps[-1]] = v
    build = lambda x: struct_of({k: build(v) for k, v in x.items()}) if isinstance(x, dict) else x
    return build(tree)


@obj("flatten_keys")
def flatten_keys(c, a):
    sep, out = (a.val(0).lit if a.count else "."), {}
    if not isinstance(c.t, T.StructType):
        raise QueryError("flatten_keys needs an object of known shape")

    def walk(v, path):
        for n in v.t.names:
            x = v.field(n)
            walk(x, [*path, n]) if isinstance(x.t, T.StructType) else out.__setitem__(sep.join([*path, n]), x)

    walk(c, [])
    return struct_of(out)


@obj("unflatten_keys")
def unflatten_keys(c, a):
    if not isinstance(c.t, T.StructType):
        raise QueryError("unflatten_keys needs an object of known shape")
    return nested(fields(c), a.val(0).lit if a.count else ".")
