"""Methods of tables and of groups, as DataFrame operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import describe
from ..functions.values import BOOL, BUILTINS, DOUBLE, LONG, NULL, STRING, C, QueryError, called, cast, common, display, dropped, equal, group_key, is_int, kept, kind, lit, numeric, struct_of, truthy, whole
from ..lang import tree as t
from ..operators.positions import POS, framed, positions, running
from . import evaluate as ev
from .relation import VALUE, Rel, Scope, column, fresh, gathered

REL = ev.REL


def rel(*names):
    def add(f):
        for n in names:
            REL[n] = f
        return f

    return add


def inside(r: Rel, a) -> tuple[Scope, object]:
    """A scope over the rows, and the environment inside them."""
    scope = Scope(r.df)
    return scope, a.env.at(r.elem, scope)


def rel_scalar(df) -> Rel:
    return Rel(df, None, single=True)


def rel_map(r: Rel, f) -> Rel:
    scope = Scope(r.df)
    return r.select(f(r.elem, scope), scope.df)


# filters and projections


@rel("filter", "find", "find_all")
def rel_filter(r, a):
    if not a.count:
        raise QueryError("find needs a predicate")
    found = correlated(r, a)
    if found is not None:
        return found
    scope, env = inside(r, a)
    cond = kept(a.fn(0, env)(r.elem))
    for i in range(1, a.count):
        cond = cond & kept(a.fn(i, env)(r.elem))
    return r.on(scope.df.where(cond))


def mentions(node, names) -> bool:
    if isinstance(node, t.Name):
        return node.name in names
    if isinstance(node, t.Node):
        return any(mentions(x, names) for v in vars(node).values() for x in (v if isinstance(v, tuple) else (v,)))
    if isinstance(node, tuple):
        return any(mentions(x, names) for x in node)
    return False


def conjuncts(node):
    if isinstance(node, t.Binary) and node.op == "and":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


def correlated(r, a):
    """A filter that compares a field with a value of the current row of
    another table: the other rows by that key."""
    if not isinstance(a.env.here, C):
        return None
    outer = {k for k, v in a.env.vars.items() if isinstance(v, C) and v.lit is ... and v.t is not None}
    parts = []
    for node in a.nodes:
        if isinstance(node, t.Lambda) and node.params:
            outer -= set(node.params)
            body = node.body
        else:
            body = node
        parts += [(p, node) for p in conjuncts(body)]
    if not any(mentions(p, outer) for p, _ in parts):
        return None
    scope, env = inside(r, a)
    keys, outers, rest, theta = [], [], [], []
    for p, node in parts:
        wrap = lambda x, node=node: t.Lambda(node.params, x) if isinstance(node, t.Lambda) else x
        if not mentions(p, outer):
            rest.append(truthy(ev.function(wrap(p), env)(r.elem)))
            continue
        if not (isinstance(p, t.Binary) and p.op == "==" and mentions(p.left, outer) != mentions(p.right, outer)):
            theta.append((wrap, p))
            continue
        own, other = (p.right, p.left) if mentions(p.left, outer) else (p.left, p.right)
        keys.append(ev.function(wrap(own), env)(r.elem))
        outers.append(ev.ec(other, a.env))
    df = scope.df
    for c in rest:
        df = df.where(c)
    r = r.on(df)
    if theta:
        return ev.Corr(ev.Grp(r, r.elem), None, None, theta_of(r, env, a.env, outer, theta, keys, outers))
    if len(keys) == 1 and kind(keys[0].t) == kind(outers[0].t):
        return ev.Corr(ev.Grp(r, r.elem), keys[0], outers[0])
    pair = lambda cs: C(F.to_json(F.array(*[display(c) for c in cs])), STRING)
    return ev.Corr(ev.Grp(r, r.elem), pair(keys), pair(outers))


def wanted(node, name) -> set | None:
    """The fields of a variable that a node mentions; None where it is
    mentioned as a whole."""
    if isinstance(node, t.Field) and node.of == t.Name(name):
        return {node.name}
    if node == t.Name(name):
        return None
    found = set()
    if isinstance(node, (t.Node, tuple)):
        for v in vars(node).values() if isinstance(node, t.Node) else node:
            some = wanted(v, name)
            if some is None:
                return None
            found |= some
    return found


def theta_of(r, env, around, outer, theta, keys, outers) -> ev.Theta:
    """The test of a filter that compares with the current row by more than
    equality: the equal keys, for the planner to join by, and the rest."""
    held: dict[str, C] = {}
    made = {}  # variable: how to rebuild it from the struct
    for name in sorted(outer):
        fields = wanted(tuple(p for _, p in theta), name)
        v = around.vars[name]
        if fields is None or v.parts is None:
            if mentions(tuple(p for _, p in theta), {name}):
                held[f"v_{name}"] = v
                made[name] = (None, v.t)
        elif fields:
            made[name] = ({f: v.field(f).t for f in sorted(fields)}, None)
            held |= {f"v_{name}_{f}": v.field(f) for f in sorted(fields)}
    held |= {f"k{i}": o for i, o in enumerate(outers)}

    def test(k):
        inner = env
        for name, (fields, ty) in made.items():
            if fields is None:
                inner = inner.let(name, C(k.getField(f"v_{name}"), ty))
            else:
                inner = inner.let(name, struct_of({f: C(k.getField(f"v_{name}_{f}"), ft) for f, ft in fields.items()}))
        got = F.lit(True)
        for i, (own, other) in enumerate(zip(keys, outers, strict=True)):
            at = C(k.getField(f"k{i}"), other.t)
            same = kind(own.t) == kind(other.t) and kind(own.t) in ("number", "string", "bool", "other")
            got = got & (whole(own).eqNullSafe(at.col) if same else display(own) == display(at))
        for wrap, p in theta:
            got = got & kept(ev.function(wrap(p), inner)(r.elem))
        return got

    plain = None
    if not keys and len(theta) == 1:
        wrap, p = theta[0]
        if isinstance(p, t.Binary) and p.op in TURNED and mentions(p.left, outer) != mentions(p.right, outer):
            own, other, op = (p.right, p.left, TURNED[p.op]) if mentions(p.left, outer) else (p.left, p.right, p.op)
            plain = (op, ev.function(wrap(own), env)(r.elem), ev.ec(other, around))
    return ev.Theta(held, test, plain)


#: A comparison with its sides exchanged.
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def by_running(c, name, a, env):
    """Of a single comparison count, sum, min and max need no pairs of rows:
    both sides are put in one order and the aggregate runs along it."""
    theta = c.theta
    if theta is None or theta.plain is None or name not in ("count", "len", "sum", "min", "max") or c.grp.cond is not None or c.grp.distinct:
        return None
    op, own, outer = theta.plain
    k = kind(own.t)
    if k != kind(outer.t) or k not in ("number", "string"):
        return None
    ty = common([own.t, outer.t])
    inner = Scope(c.grp.rel.df)
    x = a.fn(0, a.env.at(c.grp.elem, inner))(c.grp.elem) if a.count else c.grp.elem
    if name in ("count", "len"):
        value = C(F.when(truthy(x), F.lit(1).cast("long")) if a.count else F.lit(1).cast("long"), LONG)
    else:
        value = x if kind(x.t) == "number" else numeric(x)
        if name == "sum":
            value = C(whole(value).cast(LONG if is_int(value.t) else DOUBLE), LONG if is_int(value.t) else DOUBLE)
    tag = fresh("c")
    at = whole(outer).cast(ty)
    rows = inner.df.select(whole(own).cast(ty).alias("__at"), whole(value).alias("__w"), F.lit(True).alias("__in")).where("__at is not null")
    asks = env.scope.df.select(at.alias("__at")).where("__at is not null").distinct().select("__at", F.lit(None).cast(value.t).alias("__w"), F.lit(False).alias("__in"))
    # equal values pass <= and >=, so there the rows come before who asks
    both = Rel(rows.unionByName(asks), ["__at", "__w", "__in"], [("__at", op[0] == ">"), ("__in", "=" in op)])
    agg, merge = {"min": (F.min, F.least), "max": (F.max, F.greatest)}.get(name, (F.sum, lambda p, q: p + q))
    got = running(both, F.col("__w"), agg, merge)
    table = got.df.where("not __in").select(F.col("__at").alias(tag + "k"), F.col("__out").alias(tag))
    return env.scope.lookup(table, at, tag, value.t)


def corr_call(c, name, args, named, env):
    a = ev.Args(args, named, env)
    empty = {"count": lit(0), "len": lit(0), "sum": lit(0), "any": lit(False), "exists": lit(False), "all": lit(True)}.get(name)
    got = by_running(c, name, a, env)
    if got is not None:
        return got if empty is None else C(F.coalesce(got.col, whole(empty).cast(got.t)), got.t)
    scope = Scope(c.grp.rel.df)
    got = group_call(c.grp if c.theta else replace(c.grp, keyed=(whole(c.key), scope)), name, a, scope)
    if isinstance(got, ev.Grp):
        return ev.Corr(got, c.key, c.outer, c.theta)
    return ev.looked_up(c, got, env, empty)


@rel("find_first", "find_one")
def rel_find_first(r, a):
    got = rel_filter(r, a)
    return corr_call(got, "first", (), (), a.env) if isinstance(got, ev.Corr) else rel_first(got, None)


@rel("compact")
def rel_compact(r, a):
    return r if r.names is not None else r.on(r.df.where(column(VALUE).isNotNull()))


@rel("remove")
def rel_remove(r, a):
    scope, env = inside(r, a)
    if a.is_fn(0):
        return r.on(scope.df.where(~truthy(a.fn(0, env)(r.elem))))
    v = a.val(0)
    if kind(v.t) == kind(r.elem.t) and kind(v.t) in ("string", "bool"):
        return r.on(r.df.where(~equal(r.elem, v)))
    return r.on(r.df.where(display(r.elem) != display(v)))


@rel("map")
def rel_mapped(r, a):
    scope, env = inside(r, a)
    c = a.fn(0, env)(r.elem)
    return r.select(c, scope.df, keyed=False)


def rel_flat(r: Rel, f, env=None) -> Rel:
    """One row for each element of an array made of each row; anything else
    than an array is one element."""
    scope = Scope(r.df)
    c = f(r.elem) if env is None else f(r.elem)
    if not isinstance(c.t, T.ArrayType):
        return r.select(c, scope.df)
    i, tag = fresh("i"), fresh("v")
    df = scope.df.select(*r.hidden(), F.posexplode(whole(c)).alias(i, tag))
    e = C(column(tag), c.t.elementType)
    out = Rel(df, [tag], [*r.order, (i, False)] if r.order else [])
    return out.select(e)


@rel("flat_map")
def rel_flat_map(r, a):
    scope, env = inside(r, a)
    c = a.fn(0, env)(r.elem)
    return rel_flat(r.on(scope.df), lambda e: c)


@rel("flatten")
def rel_flatten(r, a):
    for _ in range(int(a.val(0).lit) if a.count else 1):
        if kind(r.elem.t) == "array":
            r = rel_flat(r, lambda e: e)
    return r


@rel("explode")
def rel_explode(r, a):
    name = a.name(0)
    v = r.elem.field(name)
    if kind(v.t) != "array":
        return r
    # a null is not an array: its row stays; an empty array leaves no row
    items = F.when(v.col.isNull(), F.array(F.lit(None).cast(v.t.elementType))).otherwise(v.col)
    i, tag = fresh("i"), fresh("v")
    df = r.df.select("*", F.posexplode(items).alias(i, tag))
    fields = {n: (C(column(tag), v.t.elementType) if n == name else c) for n, c in r.elem.parts.items()}
    return Rel(df, r.names, [*r.order, (i, False)] if r.order else []).select(struct_of(fields))


@rel("implode")
def rel_implode(r, a):
    name = a.name(0)
    rest = [n for n in r.names if n != name]
    v = r.elem.field(name)
    aggs = [whole(gathered(r, elem=v)).alias(name)]
    order = []
    if r.order:
        order = [(fresh("p"), False)]
        aggs.append(F.min(r.place()).alias(order[0][0]))
    return Rel(r.df.groupBy(*[column(n) for n in rest]).agg(*aggs), [*rest, name], order)


rel("collect")(lambda r, a: r)


@rel("pick")
def rel_pick(r, a):
    from ..functions.objects import picked
    return r.select(struct_of(picked(r.elem, a.names())))


@rel("omit")
def rel_omit(r, a):
    gone = {p for _, p in a.names()}
    return r.select(struct_of({n: c for n, c in r.elem.parts.items() if n not in gone}))


def on_rows(name):
    """A builtin of objects, used on each row."""
    def run(r, a):
        scope, env = inside(r, a)
        return r.select(BUILTINS[name](r.elem, ev.Args(a.nodes, a.named_nodes, env)), scope.df)

    rel(name)(run)


for _name in ("rename", "merge", "deep_merge", "defaults", "set_path", "del_path", "del_paths", "flatten_keys", "unflatten_keys", "walk", "walk_pre"):
    on_rows(_name)


@rel("enumerate")
def rel_enumerate(r, a):
    r = positions(r)
    return r.select(struct_of({"index": C(column(POS), LONG), "value": ev.solid(r.elem)}))


@rel("partition")
def rel_partition(r, a):
    scope, env = inside(r, a)
    ok = C(truthy(a.fn(0, env)(r.elem)), BOOL)
    r = r.on(scope.df)
    yes, no = gathered(r, ok.col), gathered(r, ~ok.col)
    return Rel(r.df.agg(yes.col.alias("true"), no.col.alias("false")), ["true", "false"], single=True)


@rel("fanout")
def rel_whole(r, a):
    """Expressions of the whole table, each a value of its own."""
    scope = Scope(r.df.sparkSession.range(1).select())
    env = a.env.at(r, scope)
    got = ev.array_of([ev.as_c(ev.evaluate(n, env), env) for n in a.nodes])
    return Rel(scope.df, [], single=True).select(got)


@rel("zip_shape")
def rel_zip_shape(r, a):
    """An object of named expressions of the whole table."""
    scope = Scope(r.df.sparkSession.range(1).select())
    env = a.env.at(r, scope)
    nodes = {a.name(i): n for i, n in enumerate(a.nodes)} | a.named_nodes
    got = struct_of({k: ev.as_c(ev.evaluate(n, env), env) for k, n in nodes.items()})
    return Rel(scope.df, [], single=True).select(got)


# positions and limits


def amount(a, i=0) -> int:
    n = a.val(i).lit
    if not isinstance(n, int):
        raise QueryError("needs a literal count")
    return n


def rel_take(r, n: int) -> Rel:
    return r.on(r.df.orderBy(*r.sorting()).limit(n) if r.order else r.df.limit(n))


def rel_skip(r, n: int) -> Rel:
    p = positions(r)
    return p.on(p.df.where(F.col(POS) >= n))


rel("take")(lambda r, a: rel_take(r, amount(a)))
rel("skip", "drop")(lambda r, a: rel_skip(r, amount(a)))


@rel("first")
def rel_first(r, a):
    if a is not None and a.count and amount(a) != 1:
        return rel_take(r, amount(a))
    return replace(rel_take(r, 1), single=True)


@rel("last")
def rel_last(r, a):
    n = amount(a) if a is not None and a.count else 1
    got = r.on(r.df.orderBy(*r.sorting(back=True)).limit(n))
    return replace(got, single=True) if n == 1 else got


def rel_nth(r, i: int) -> Rel:
    if i >= 0:
        return replace(r.on(r.df.orderBy(*r.sorting()).offset(i).limit(1)), single=True)
    # from the end; beyond the first it is the first
    got = r.df.orderBy(*r.sorting(back=True)).limit(-i)
    return replace(r.on(got.orderBy(*r.sorting()).limit(1)), single=True)


rel("nth")(lambda r, a: rel_nth(r, amount(a)))


def stop_place(r, a, want: bool):
    """The scope, and the place of the first row that is (not) truthy."""
    scope, env = inside(r, a)
    ok = truthy(a.fn(0, env)(r.elem))
    for i in range(1, a.count):
        ok = ok & truthy(a.fn(i, env)(r.elem))
    r = r.on(scope.df)
    tag = fresh("stop")
    at = r.df.where(ok if want else ~ok).agg(F.min(r.place()).alias(tag))
    return r, at, tag


@rel("take_while", "takewhile")
def rel_take_while(r, a):
    r, at, tag = stop_place(r, a, False)
    df = r.df.join(F.broadcast(at), F.lit(True))
    return r.on(df.where(column(tag).isNull() | (r.place() < column(tag))).drop(tag))


@rel("drop_while", "dropwhile")
def rel_drop_while(r, a):
    r, at, tag = stop_place(r, a, False)
    return r.on(r.df.join(F.broadcast(at), F.lit(True)).where(r.place() >= column(tag)).drop(tag))


@rel("find_index")
def rel_find_index(r, a):
    """How many rows stand before the first match: two aggregates, no numbering."""
    r, at, tag = stop_place(r, a, True)
    got = r.df.join(F.broadcast(at), F.lit(True)).agg(F.max(column(tag)).alias("s"), F.count_if(r.place() < column(tag)).alias("n"))
    return rel_scalar(got.select(F.when(F.col("s").isNotNull(), F.col("n")).alias(VALUE)))


@rel("indices_where")
def rel_indices_where(r, a):
    r = positions(r)
    scope, env = inside(r, a)
    ok = truthy(a.fn(0, env)(r.elem))
    return r.on(scope.df.where(ok)).select(C(column(POS), LONG))


@rel("indices_of")
def rel_indices_of(r, a):
    r = positions(r)
    return r.on(r.df.where(equal(r.elem, a.val(0)))).select(C(column(POS), LONG))


@rel("index")
def rel_index_of(r, a):
    tag = fresh("stop")
    at = r.df.where(equal(r.elem, a.val(0))).agg(F.min(r.place()).alias(tag))
    got = r.df.join(F.broadcast(at), F.lit(True)).agg(F.max(column(tag)).alias("s"), F.count_if(r.place() < column(tag)).alias("n"))
    return rel_scalar(got.select(F.when(F.col("s").isNotNull(), F.col("n")).alias(VALUE)))


def by_extreme(down):
    def run(r, a):
        scope, env = inside(r, a)
        key = whole(a.fn(0, env)(r.elem))
        keys = [key.desc_nulls_last() if down else key.asc_nulls_last(), *(r.sorting() if r.order else [])]
        return replace(r.on(scope.df.orderBy(*keys).limit(1)), single=True)

    return run


rel("max_by")(by_extreme(True))
rel("min_by")(by_extreme(False))


# order, distinct, sets


@rel("sort", "sort_by")
def rel_sort(r, a):
    if a.count == 1 and a.arity(0) == 2:
        raise QueryError("a table is sorted by keys, not by a comparison")
    scope, env = inside(r, a)
    keys = [a.sort_key(i, env) for i in range(a.count)] or [(lambda x: x, False)]
    order, df = [], None
    cols = []
    for f, down in keys:
        n = fresh("k")
        cols.append(whole(f(r.elem)).alias(n))
        order.append((n, down))
    df = scope.df.select("*", *cols)
    return replace(r, df=df, order=order + [o for o in r.order])


rel("reverse")(lambda r, a: replace(r, order=[(n, not down) for n, down in (r.order or r.sorting())]))


def distinct_by(r: Rel, key: C, df) -> Rel:
    k = fresh("u")
    df = df.withColumn(k, group_key(key)[0])
    if not r.order:
        return r.on(df.dropDuplicates([k]).drop(k))
    # a column each, so that those that the query does not use are not read
    place, schema = r.on(df).place(), df.schema
    names = [*r.columns(), *[n for n, _ in r.order if n not in r.columns()]]
    best = df.groupBy(k).agg(*[F.min_by(column(n), place).alias(n, metadata=schema[n].metadata) for n in names])
    return r.on(best.drop(k))


@rel("unique", "distinct")
def rel_unique(r, a=None):
    if r.names is not None and not r.order:
        return r.on(r.df.dropDuplicates(r.names))
    return distinct_by(r, r.elem, r.df)


@rel("unique_by")
def rel_unique_by(r, a):
    scope, env = inside(r, a)
    return distinct_by(r, a.fn(0, env)(r.elem), scope.df)


def rel_concat(parts: list[Rel]) -> Rel:
    """One table after another; ordered if each of them is."""
    ordered = all(p.order or p.single for p in parts)
    ty = common([p.elem.t for p in parts])
    out = []
    for i, p in enumerate(parts):
        if ordered and not p.single:
            p = positions(p)
        c = cast(p.elem, ty)
        cols = [called(whole(C(c.col, ty).field(n) if c.parts is None else c.field(n)), n, dropped(ty[n])) for n in ty.names] if isinstance(ty, T.StructType) else [c.col.alias(VALUE)]
        hidden = [F.lit(i).alias("__part"), (F.lit(0).cast("long") if p.single else column(POS)).alias("__at")] if ordered else []
        out.append(p.df.select(*cols, *hidden))
    df = out[0]
    for o in out[1:]:
        df = df.unionByName(o)
    return Rel(df, list(ty.names) if isinstance(ty, T.StructType) else None, [("__part", False), ("__at", False)] if ordered else [])


def as_rel(value, r: Rel, env) -> Rel:
    if isinstance(value, Rel):
        return value
    if isinstance(value, ev.Grouped):
        return from_grouped(value)
    c = ev.as_c(value, env)
    spark = r.df.sparkSession
    if kind(c.t) != "array":
        return Rel(spark.range(1).select(whole(c).alias(VALUE)), None, single=True).select(C(column(VALUE), c.t))
    got = Rel(spark.range(1).select(F.posexplode(whole(c)).alias("__at0", VALUE)), None, [("__at0", False)])
    return got.select(C(column(VALUE), c.t.elementType))


rel("append")(lambda r, a: rel_concat([r, as_rel(a.raw(0) if a.count else NULL, r, a.env)]))
rel("prepend")(lambda r, a: rel_concat([as_rel(a.raw(0) if a.count else NULL, r, a.env), r]))


def keyed_pair(r: Rel, o: Rel):
    """Key columns of two tables that are equal when the display texts are."""
    x, y = r.elem, o.elem
    if type(x.t) is type(y.t) and (isinstance(x.t, T.StringType) or is_int(x.t) or isinstance(x.t, T.BooleanType)):
        a, b = group_key(x)[0], group_key(y)[0]
    elif is_int(x.t) and is_int(y.t):
        a, b = whole(x).cast("bigint"), whole(y).cast("bigint")
    else:
        a, b = display(x), display(y)
    k, l = fresh("k"), fresh("l")  # noqa: E741
    return r.df.withColumn(k, a), o.df.select(b.alias(l)), k, l


def set_op(how):
    def run(r, a):
        o = as_rel(a.raw(0), r, a.env)
        x, y, k, l = keyed_pair(r, o)  # noqa: E741
        return r.on(x.join(y, column(k).eqNullSafe(column(l)), how).drop(k))

    return run


rel("diff")(set_op("left_anti"))
rel("intersect")(set_op("left_semi"))


@rel("union")
def rel_union(r, a):
    o = as_rel(a.raw(0), r, a.env)
    x, y, k, l = keyed_pair(o, r)  # noqa: E741
    more = o.on(x.join(y, column(k).eqNullSafe(column(l)), "left_anti").drop(k))
    return rel_concat([r, more])


def zipped(r, o, fill, how):
    p, q = positions(r), positions(o)
    a, b = fresh("a"), fresh("b")
    x = p.df.select(column(POS), whole(p.elem).alias(a), F.lit(True).alias("__x"))
    y = q.df.select(column(POS), whole(q.elem).alias(b), F.lit(True).alias("__y"))
    df = x.join(y, POS, how)
    u, v = C(column(a), p.elem.t), C(column(b), q.elem.t)
    ty = common([u.t, v.t] + ([fill.t] if fill is not None else []))
    u, v = cast(u, ty), cast(v, ty)
    if fill is not None:
        f = cast(fill, ty).col
        u, v = C(F.when(column("__x"), u.col).otherwise(f), ty), C(F.when(column("__y"), v.col).otherwise(f), ty)
    return Rel(df, None, [(POS, False)]).select(C(F.array(u.col, v.col), T.ArrayType(ty)))


rel("zip")(lambda r, a: zipped(r, as_rel(a.raw(0), r, a.env), None, "inner"))
rel("zip_longest")(lambda r, a: zipped(r, as_rel(a.raw(0), r, a.env), a.named("fill") or NULL, "full"))


@rel("window")
def rel_window(r, a):
    n = amount(a)
    got = framed(r, n - 1, 0, lambda w: F.when(F.col(POS) >= n - 1, F.collect_list(F.struct(whole(r.elem).alias("v"))).over(w.rowsBetween(-(n - 1), 0))))
    got = replace(got, names=None, df=got.df.where(F.col("__out").isNotNull()))
    return got.select(C(F.transform("__out", lambda x: x.getField("v")), T.ArrayType(r.elem.t)))


@rel("pairwise")
def rel_pairwise(r, a):
    got = framed(r, 0, 1, lambda w: F.lead(F.struct(whole(r.elem).alias("v"))).over(w))
    got = replace(got, df=got.df.where(F.col("__out").isNotNull()))
    return got.select(C(F.array(whole(r.elem), F.col("__out.v")), T.ArrayType(r.elem.t)))


@rel("chunk", "batch")
def rel_chunk(r, a):
    n = amount(a)
    p = positions(r)
    got = p.df.groupBy(F.floor(F.col(POS) / n).alias("__chunk")).agg(whole(gathered(p)).alias(VALUE))
    return Rel(got, None, [("__chunk", False)])


@rel("includes", "contains")
def rel_includes(r, a):
    v = a.val(0)
    return rel_scalar(r.df.agg(F.coalesce(F.bool_or(display(r.elem) == display(v)), F.lit(False)).alias(VALUE)))


@rel("has")
def rel_has(r, a):
    if not r.keyed:
        return rel_includes(r, a)
    return rel_scalar(r.df.agg(F.coalesce(F.bool_or(column("key") == display(a.val(0))), F.lit(False)).alias(VALUE)))


# aggregates


def reduced(name, x: C, cond=None, distinct=False):
    """An aggregate Column of a value; only numbers count."""
    n = x if kind(x.t) == "number" else numeric(x)
    col = whole(n)
    if isinstance(n.t, T.DecimalType):
        pass
    if cond is not None:
        col = F.when(cond, col)
    if name == "sum":
        ty = LONG if is_int(n.t) else DOUBLE
        got = F.sum_distinct(col) if distinct else F.sum(col)
        return C(F.coalesce(got.cast(ty), F.lit(0).cast(ty)), ty)
    if name == "avg":
        return C((F.avg(col) if not distinct else F.sum_distinct(col) / F.count_distinct(col)).cast("double"), DOUBLE)
    return C((F.min if name == "min" else F.max)(col), n.t)


def projected(r, a):
    scope, env = inside(r, a)
    x = a.fn(0, env)(r.elem) if a.count else r.elem
    return x, scope.df


def reducer(name):
    def run(r, a):
        x, df = projected(r, a)
        return rel_scalar(df.agg(reduced(name, x).col.alias(VALUE)))

    rel(name)(run)


for _name in ("sum", "avg", "min", "max"):
    reducer(_name)


@rel("count", "len")
def rel_count(r, a):
    if a is None or not a.count:
        return rel_scalar(r.df.agg(F.count("*").alias(VALUE)))
    x, df = projected(r, a)
    return rel_scalar(df.agg(F.count_if(truthy(x)).alias(VALUE)))


@rel("approx_count_distinct")
def rel_approx(r, a):
    x, df = projected(r, a)
    return rel_scalar(df.agg(F.approx_count_distinct(group_key(x)[0], 0.016).alias(VALUE)))


@rel("any", "exists")
def rel_any(r, a):
    x, df = projected(r, a)
    return rel_scalar(df.agg(F.coalesce(F.bool_or(truthy(x)), F.lit(False)).alias(VALUE)))


@rel("all")
def rel_all(r, a):
    x, df = projected(r, a)
    return rel_scalar(df.agg(F.coalesce(F.bool_and(truthy(x)), F.lit(True)).alias(VALUE)))


# keyed results


@rel("group_by")
def rel_group_by(r, a):
    scope, env = inside(r, a)
    key = a.fn(0, env)(r.elem)
    return ev.Grouped(r.on(scope.df), key, scope)


def keyed(df, key: C, aggs, names, r=None) -> Rel:
    """Group by a key's own type and show the display text."""
    col, is_text = group_key(key)
    k = fresh("g")
    got = df.groupBy(col.alias(k)).agg(*aggs)
    shown = column(k) if is_text else display(C(column(k), key.t))
    return Rel(got.select(shown.alias("key"), *[column(n) for n in names]), ["key", *names], keyed=True)


def from_grouped(g) -> Rel:
    return keyed(g.scope.df, g.key, [whole(gathered(g.rel)).alias(VALUE)], [VALUE])


@rel("count_by")
def rel_count_by(r, a):
    x, df = projected(r, a)
    return keyed(df, x, [F.count("*").alias(VALUE)], [VALUE])


def rel_index(r: Rel, key: C, df, value=None) -> Rel:
    """Key to last row."""
    names = value or r.columns()
    if "key" in names and not value:
        row = F.struct(F.struct(*[column(n) for n in names]).alias(VALUE))
        names = [VALUE]
    else:
        row = F.struct(*[column(n) for n in names])
    if r.order and names != [VALUE]:
        place = r.on(df).place()
        return Rel(keyed(df, key, [F.max_by(column(n), place).alias(n, metadata=df.schema[n].metadata) for n in names], names).df, ["key", *names], keyed=True)
    pick = F.max_by(row, r.on(df).place()) if r.order else F.last(row)
    got = keyed(df, key, [pick.alias("__row")], ["__row"])
    return Rel(got.df.select("key", "__row.*"), ["key", *names], keyed=True)


@rel("index_by")
def rel_index_by(r, a):
    scope, env = inside(r, a)
    return rel_index(r, a.fn(0, env)(r.elem), scope.df)


@rel("group_shape")
def rel_group_shape(r, a):
    scope, env = inside(r, a)
    key = a.fn(0, env)(r.elem)
    return rel_shape(ev.Grouped(r.on(scope.df), key, scope), a, 1)


def rel_shape(g, a, at=0) -> Rel:
    """A shape of each group: reducers become one partial and final aggregate."""
    grp = ev.Grp(g.rel.on(g.scope.df), g.rel.elem, keyed=(group_key(g.key)[0], g.scope))
    node = a.nodes[at]
    body = node.body if isinstance(node, t.Lambda) else node
    env = a.env.at(grp, g.scope)
    if isinstance(node, t.Lambda) and node.params:
        env = env.let(node.params[0], grp)
    c = ev.as_c(ev.evaluate(body, env), env)
    fields = {n: c.field(n) for n in c.t.names} if isinstance(c.t, T.StructType) else {VALUE: c}
    if "key" in fields:
        fields = {VALUE: c}
    return keyed(g.scope.df, g.key, [whole(v).alias(n) for n, v in fields.items()], list(fields))


def group_call(g, name, a, scope=None):
    """A method of a group: an aggregate where one fits, or the group as an
    array, in order, for what has no aggregate."""
    scope = scope or a.env.scope
    env = a.env.at(g.elem, scope)
    of = lambda i: a.fn(i, env)(g.elem)
    both = lambda c: c if g.cond is None else g.cond & c
    if g.distinct and name in ("count", "len") and not a.count:
        k = group_key(g.elem)[0]
        return C(F.count_distinct(k if g.cond is None else F.when(g.cond, k)), LONG)
    if g.distinct and name not in ("sum", "avg", "min", "max"):
        return BUILTINS[name](ev.group_array(g), a)
    if name in ("filter", "find", "find_all") and a.count:
        cond = truthy(of(0))
        for i in range(1, a.count):
            cond = cond & truthy(of(i))
        return replace_grp(g, cond=both(cond))
    if name == "map":
        return replace_grp(g, elem=of(0))
    if name in ("unique", "distinct") and kind(g.elem.t) in ("number", "string", "bool"):
        return replace_grp(g, distinct=True)
    if name in ("count", "len"):
        cond = both(truthy(of(0))) if a.count else g.cond
        return C(F.count("*") if cond is None else F.count_if(cond), LONG)
    if name in ("sum", "avg", "min", "max"):
        return reduced(name, of(0) if a.count else g.elem, g.cond, g.distinct)
    if name == "approx_count_distinct":
        k = group_key(g.elem)[0]
        return C(F.approx_count_distinct(k if g.cond is None else F.when(g.cond, k), 0.016), LONG)
    if name in ("any", "exists", "all"):
        x = truthy(of(0) if a.count else g.elem)
        x = x if g.cond is None else F.when(g.cond, x)
        return C(F.coalesce((F.bool_and if name == "all" else F.bool_or)(x), F.lit(name == "all")), BOOL)
    if name in ("first", "last") and not a.count and g.rel.order:
        place = g.rel.place() if g.cond is None else F.when(g.cond, g.rel.place())
        return C((F.min_by if name == "first" else F.max_by)(whole(g.elem), place), g.elem.t)
    if name in ("max_by", "min_by") and a.count:
        key = whole(of(0))
        if g.rel.order:
            key = F.struct(key.alias("k"), g.rel.place(back=name == "max_by").alias("p"))
        key = key if g.cond is None else F.when(g.cond, key)
        return C((F.max_by if name == "max_by" else F.min_by)(whole(g.elem), key), g.elem.t)
    if name == "collect":
        return ev.group_array(g)
    if name in BY_WINDOW and g.keyed and g.rel.order and not g.rel.df.isStreaming:
        return windowed(g, name, a)
    if name not in BUILTINS:
        raise QueryError(f"no function {name!r}")
    return BUILTINS[name](ev.group_array(g), a)


def windowed(g, name, a) -> ev.Grp:
    """An analytic of each group as a column of its rows, by windows that keep
    no group in memory. The rows lie as in the group's array: by the order, then
    by value; those a filter left out come last and count as none. From here on
    their position is the order."""
    n = amount(a) if a.count else 1
    if n < 1:
        raise QueryError(f"{name} needs a positive size")
    key, scope = g.keyed
    x, tie, pos, out = numeric(g.elem).col, fresh("v"), fresh("p"), fresh("w")
    left_out = [] if g.cond is None else [(~g.cond).asc()]
    over = W.partitionBy(key).orderBy(*left_out, *g.rel.sorting(), column(tie))

    def put(at, col):
        scope.df = scope.df.withColumn(at, col)
        return column(at)

    v = put(tie, x if g.cond is None else F.when(g.cond, x))
    put(out, BY_WINDOW[name](v, n, over, put(pos, F.row_number().over(over) - 1), lambda col: put(fresh("s"), col)))
    return replace(g, rel=g.rel.on(scope.df, order=[(pos, False)]), elem=C(column(out), DOUBLE))


def replace_grp(g, **more):
    return replace(g, **more)


@rel("pivot")
def rel_pivot(r, a):
    f = r.elem.field
    value = f(a.name(a.count - 1))
    pick = F.max_by(value.col, r.place()) if r.order else F.last(value.col)
    if a.count == 2:
        return keyed(r.df, f(a.name(0)), [pick.alias(VALUE)], [VALUE])
    row, col = f(a.name(0)), f(a.name(1))
    got = r.df.select("*", display(row).alias("__pr"), display(col).alias("__pc")).groupBy("__pr").pivot("__pc").agg(pick)
    names = [n for n in got.columns if n != "__pr"]
    return Rel(got.withColumnRenamed("__pr", "key"), ["key", *names], keyed=True)


def need_keyed(f):
    def run(r, a):
        if not r.keyed:
            raise QueryError("this needs an object, not an array")
        return f(r, a)

    return run


def value_of(r: Rel) -> C:
    parts = {n: c for n, c in r.elem.parts.items() if n != "key"}
    return parts[VALUE] if list(parts) == [VALUE] else struct_of(parts)


rel("keys")(need_keyed(lambda r, a: replace(r, keyed=False).select(r.elem.field("key"))))
rel("values")(need_keyed(lambda r, a: replace(r, keyed=False).select(value_of(r))))
rel("to_pairs")(need_keyed(lambda r, a: replace(r, keyed=False).select(struct_of({"key": r.elem.field("key"), "val": ev.solid(value_of(r))}))))


@rel("entries")
@need_keyed
def rel_entries(r, a):
    k, v = r.elem.field("key"), value_of(r)
    ty = common([k.t, v.t])
    return replace(r, keyed=False).select(C(F.array(cast(k, ty).col, cast(v, ty).col), T.ArrayType(ty)))


@rel("transform_values")
@need_keyed
def rel_transform_values(r, a):
    scope = Scope(r.df)
    got = a.fn(0, a.env.at(value_of(r), scope))(value_of(r))
    fields = {n: got.field(n) for n in got.t.names} if isinstance(got.t, T.StructType) and "key" not in got.t.names else {VALUE: got}
    return r.select(struct_of({"key": r.elem.field("key")} | fields), scope.df)


@rel("transform_keys")
@need_keyed
def rel_transform_keys(r, a):
    scope = Scope(r.df)
    k = a.fn(0, a.env.at(r.elem.field("key"), scope))(r.elem.field("key"))
    parts = dict(r.elem.parts) | {"key": C(display(k), STRING)}
    return r.select(struct_of(parts), scope.df)


@rel("filter_keys")
@need_keyed
def rel_filter_keys(r, a):
    scope = Scope(r.df)
    return r.on(scope.df.where(truthy(a.fn(0, a.env.at(r.elem.field("key"), scope))(r.elem.field("key")))))


@rel("filter_values")
@need_keyed
def rel_filter_values(r, a):
    scope = Scope(r.df)
    return r.on(scope.df.where(truthy(a.fn(0, a.env.at(value_of(r), scope))(value_of(r)))))


@rel("invert")
@need_keyed
def rel_invert(r, a):
    return r.select(struct_of({"key": C(display(value_of(r)), STRING), "value": r.elem.field("key")}))


@rel("from_pairs")
def rel_from_pairs(r, a):
    e = r.elem
    if isinstance(e.t, T.StructType):
        kn = next(n for n in ("key", "k") if n in e.t.names)
        vn = next(n for n in ("val", "value", "v") if n in e.t.names)
        k, v = e.field(kn), e.field(vn)
    else:
        k, v = C(F.get(whole(e), 0), e.t.elementType), C(F.get(whole(e), 1), e.t.elementType)
    pairs = r.select(struct_of({"key": C(display(k), STRING), "value": v}))
    return rel_index(pairs, pairs.elem.field("key"), pairs.df, value=["value"])


# analytics

#: of a value, a count, a window over a group in order, the position in it and
#: what makes a column of a step between
BY_WINDOW = {}


def analytic(name, before, after, expr):
    BY_WINDOW[name] = lambda x, n, w, pos, put: expr(x, n, w, pos)

    def run(r, a):
        n = amount(a) if a.count else 1
        if n < 1:
            raise QueryError(f"{name} needs a positive size")
        x = numeric(r.elem).col
        got = framed(r, before(n), after(n), lambda w: expr(x, n, w, F.col(POS)))
        return replace(got, names=None).select(C(F.col("__out"), DOUBLE))

    rel(name)(run)


def rolled(f):
    return lambda x, n, w, pos: F.when(pos >= n - 1, f(x).over(w.rowsBetween(-(n - 1), 0)))


back, none = (lambda n: n - 1), (lambda n: 0)
analytic("rolling_sum", back, none, lambda x, n, w, pos: F.when(pos >= n - 1, F.coalesce(F.sum(x).over(w.rowsBetween(-(n - 1), 0)), F.lit(0.0))))
analytic("rolling_avg", back, none, rolled(F.avg))
analytic("rolling_min", back, none, rolled(F.min))
analytic("rolling_max", back, none, rolled(F.max))
analytic("lag", lambda n: n, none, lambda x, n, w, pos: F.lag(x, n).over(w))
analytic("lead", none, lambda n: n, lambda x, n, w, pos: F.lead(x, n).over(w))
analytic("diff_window", lambda n: 1, none, lambda x, n, w, pos: x - F.lag(x).over(w))
analytic("pct_change", lambda n: 1, none, lambda x, n, w, pos: F.try_divide(x - F.lag(x).over(w), F.lag(x).over(w)))


def cumulative(name, agg, merge):
    BY_WINDOW[name] = lambda x, n, w, pos, put: agg(x).over(w.rowsBetween(W.unboundedPreceding, 0))

    def run(r, a):
        got = running(r, numeric(r.elem).col, agg, merge)
        return replace(got, names=None).select(C(F.col("__out"), DOUBLE))

    rel(name)(run)


cumulative("cummax", F.max, F.greatest)
cumulative("cummin", F.min, F.least)


@rel("zscore")
def rel_zscore(r, a):
    x = numeric(r.elem).col
    m, s = fresh("m"), fresh("s")
    stats = r.df.agg(F.avg(x).alias(m), F.stddev_pop(x).alias(s))
    df = r.df.join(F.broadcast(stats), F.lit(True))
    z = F.when(x.isNotNull(), F.when(column(s) == 0, 0.0).otherwise((x - column(m)) / column(s)))
    return replace(r, df=df.withColumn("__out", z), names=None).select(C(F.col("__out"), DOUBLE))


def zscore_by_window(x, n, w, pos, put):
    rows = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mean = put(F.avg(x).over(rows))
    sd = put(F.sqrt(F.avg((x - mean) * (x - mean)).over(rows)))
    return F.when(x.isNotNull(), F.when(sd == 0, 0.0).otherwise((x - mean) / sd))


BY_WINDOW["zscore"] = zscore_by_window


@rel("accumulate")
def rel_accumulate(r, a):
    """Running sums run in blocks; any other fold goes over one array."""
    node = a.nodes[0]
    if isinstance(node, t.Lambda) and len(node.params) == 2 and isinstance(node.body, t.Binary) and node.body.op == "+":
        acc, x = node.params
        sides = [node.body.left, node.body.right]
        if t.Name(acc) in sides and t.Name(x) in sides and kind(r.elem.t) == "number":
            ty = LONG if is_int(r.elem.t) else DOUBLE
            got = running(r, r.elem.col, F.sum, lambda p, q: p + q)
            return replace(got, names=None).select(C(F.col("__out").cast(ty), ty))
    arr = BUILTINS["accumulate"](ev.as_c(r, a.env), a)
    return as_rel(arr, r, a.env) if arr.lit is not ... else exploded(arr, a.env)


def exploded(c: C, env) -> Rel:
    got = Rel(env.scope.df.select(F.posexplode(whole(c)).alias("__at0", VALUE)), None, [("__at0", False)])
    return got.select(C(column(VALUE), c.t.elementType))


# joins


@rel("equi_join")
def rel_equi_join(r, a):
    """Inner join by key text; the right row's fields win; left order, then
    right order. Keys of one kind are compared as they are, null with null."""
    o = as_rel(a.raw(0), r, a.env)
    lk, rk = r.elem.field(a.name(1)), o.elem.field(a.name(2))
    if kind(lk.t) == "null" or kind(rk.t) == "null":
        return r.on(r.df.where(F.lit(False)))
    tag = fresh("j")
    right = o.df.select(*[column(n).alias(f"{tag}_{n}") for n in o.names], *[column(n).alias(f"{tag}_{n}") for n, _ in o.order if n not in o.names], whole(rk).alias(f"{tag}k"))
    if isinstance(lk.t, T.StringType) and isinstance(rk.t, T.StringType):
        on = F.coalesce(lk.col, F.lit("null")) == F.coalesce(column(f"{tag}k"), F.lit("null"))
    elif is_int(lk.t) and is_int(rk.t):
        on = lk.col.eqNullSafe(column(f"{tag}k"))
    else:
        on = display(lk) == display(C(column(f"{tag}k"), rk.t))
    df = r.df.join(right, on)
    fields = {n: (C(column(f"{tag}_{n}"), o.elem.field(n).t) if n in o.names else r.elem.field(n)) for n in dict.fromkeys([*r.names, *o.names])}
    order = [*r.order, *[(f"{tag}_{n}", d) for n, d in o.order]] if r.order and o.order else []
    held = []
    for n, d in order:  # order columns keep their values under fresh names
        h = fresh("h")
        df = df.withColumn(h, column(n))
        held.append((h, d))
    return Rel(df, None, held).select(struct_of(fields))


# trees and text


def deep_rows(name):
    rel(name)(lambda r, a: rel_flat(r, lambda e: BUILTINS[name](e, a)))


for _name in ("deep_find", "deep_shape", "deep_like", "trace_path"):
    deep_rows(_name)


@rel("schema")
def rel_schema(r, a):
    return rel_scalar(r.df.sparkSession.range(1).select(F.lit(describe(T.ArrayType(r.elem.t))).alias(VALUE)))


@rel("type")
def rel_type(r, a):
    return rel_scalar(r.df.sparkSession.range(1).select(F.lit("object" if r.keyed else "array").alias(VALUE)))


rel_positions = positions


# free functions


def free(name):
    def add(f):
        ev.FREE[name] = f
        return f

    return add


@free("coalesce")
def free_coalesce(n, env):
    return ev.coalesce([ev.ec(x, env) for x in n.args])


def free_concat(n, env):
    values = [ev.evaluate(x, env) for x in n.args]
    if any(isinstance(v, Rel) for v in values):
        some = next(v for v in values if isinstance(v, Rel))
        return rel_concat([as_rel(v, some, env) for v in values])
    parts = [BUILTINS["collect"](ev.as_c(v, env), None) for v in values]
    ty = T.ArrayType(common([p.t.elementType for p in parts]))
    return C(F.concat(*[cast(p, ty).col for p in parts]), ty)


ev.FREE["chain"] = free_concat


@free("join")
def free_join(n, env):
    if len(n.args) == 2:
        b = ev.evaluate(n.args[1], env)
        if not (isinstance(b, C) and kind(b.t) == "string"):
            return free_concat(n, env)
    return ev.call_method(ev.evaluate(n.args[0], env), "join", n.args[1:], n.named, env)


@free("zip")
def free_zip(n, env):
    return ev.call_method(ev.evaluate(n.args[0], env), "zip", n.args[1:], n.named, env)


@free("zip_longest")
def free_zip_longest(n, env):
    return ev.call_method(ev.evaluate(n.args[0], env), "zip_longest", n.args[1:], n.named, env)


@free("range")
def free_range(n, env):
    args = [ev.ec(x, env) for x in n.args]
    start, stop = (lit(0), args[0]) if len(args) == 1 else args[:2]
    step = args[2] if len(args) > 2 else lit(1)
    lo, hi, by = start.col, stop.col, step.col
    some = F.when((by > 0) & (lo < hi) | (by < 0) & (lo > hi), F.sequence(lo, hi - F.signum(by).cast("long"), by))
    return C(F.coalesce(some, F.array().cast("array<bigint>")), T.ArrayType(LONG))


def _combined(lists, items):
    return F.flatten(F.transform(lists, lambda p: F.transform(items, lambda y: F.array_append(p, y))))


@free("product")
def free_product(n, env):
    """All combinations, as arrays: the last varies fastest."""
    values = [ev.evaluate(x, env) for x in n.args]
    if not any(isinstance(v, Rel) for v in values):
        got = None
        for v in (ev.as_c(v, env) for v in values):
            if got is None:
                got = C(F.transform(whole(v), lambda x: F.array(x)), T.ArrayType(T.ArrayType(v.t.elementType)))
                continue
            ty = common([got.t.elementType.elementType, v.t.elementType])
            got = C(_combined(cast(got, T.ArrayType(T.ArrayType(ty))).col, cast(v, T.ArrayType(ty)).col), T.ArrayType(T.ArrayType(ty)))
        return got
    some = next(v for v in values if isinstance(v, Rel))
    rels = [as_rel(v, some, env) for v in values]
    ty = common([r.elem.t for r in rels])
    df, cols, order = None, [], []
    for r in rels:
        tag = fresh("x")
        one = r.df.select(whole(cast(r.elem, ty)).alias(tag), *[column(n).alias(f"{tag}_{i}") for i, (n, _) in enumerate(r.order)])
        df = one if df is None else df.crossJoin(one)
        cols.append(column(tag))
        order += [(f"{tag}_{i}", d) for i, (_, d) in enumerate(r.order)]
    if not all(r.order for r in rels):
        order = []
    return Rel(df, None, order).select(C(F.array(*cols), T.ArrayType(ty)))


