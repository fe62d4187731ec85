"""Evaluation of a syntax tree: to Columns inside rows, to DataFrames above."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..functions.numbers import coalesce, convert, kind_test
from ..functions.objects import merged
from ..functions.values import (  # noqa: F401
    BOOL, BUILTINS, DOUBLE, LONG, NULL, STRING, C, QueryError, array_of, bare_order, cast, common, display, equal, group_key, kept, is_int, kind, lit, numeric, order, solid, struct_of, truthy, whole)
from ..lang import tree as t
from .relation import Rel, Scope, column, fresh, gathered


@dataclass
class Doc:
    """The document: registered tables, and the fields of a document row."""

    tables: dict[str, Rel]
    row: C | None = None


@dataclass
class Grp:
    """The rows of a group, as the current item of a shape: what a reducer of
    it gives is an aggregate Column. ``keyed`` is the key and the scope of the
    rows, where columns by window can be added to them."""

    rel: Rel
    elem: C
    cond: Column | None = None
    distinct: bool = False
    keyed: tuple[Column, Scope] | None = None


@dataclass
class Theta:
    """A test between rows of another table and the current row that is not an
    equality alone. ``outers`` are the current row's values that it needs, by
    name; ``test`` makes the Column of it from a struct of them. ``plain`` is
    (operator, own value, name of the current row's) of a single comparison."""

    outers: dict[str, C]
    test: object
    plain: tuple | None = None


@dataclass
class Corr:
    """Rows of another table whose key equals a value of the current row, or
    that pass a test with it."""

    grp: Grp
    key: C | None
    outer: C | None
    theta: Theta | None = None


@dataclass
class Grouped:
    """group_by before its groups are asked for."""

    rel: Rel
    key: C
    scope: Scope


@dataclass(frozen=True)
class Env:
    vars: dict
    here: object
    scope: Scope
    doc: Doc
    trying: bool = False

    def let(self, name, value):
        return replace(self, vars=self.vars | {name: value})

    def at(self, here, scope=None):
        return replace(self, here=here, scope=scope or self.scope)


@dataclass
class Closure:
    node: t.Lambda
    env: Env


class Args:
    """The arguments of a call, evaluated as the builtin asks for them."""

    def __init__(self, nodes, named, env: Env):
        self.nodes, self.named_nodes, self.env = nodes, dict(named), env
        self.count, self.trying = len(nodes), env.trying

    def val(self, i) -> C:
        if i >= self.count:
            raise QueryError("an argument is missing")
        return as_c(evaluate(self.nodes[i], self.env), self.env)

    def raw(self, i):
        return evaluate(self.nodes[i], self.env)

    def named(self, name):
        return as_c(evaluate(self.named_nodes[name], self.env), self.env) if name in self.named_nodes else None

    def fn(self, i, env=None):
        if i >= self.count:
            raise QueryError("an argument is missing")
        return function(self.nodes[i], env or self.env)

    def is_fn(self, i):
        return isinstance(self.nodes[i], t.Lambda)

    def arity(self, i):
        return len(self.nodes[i].params) if isinstance(self.nodes[i], t.Lambda) else 1

    def sort_key(self, i, env=None):
        node = self.nodes[i]
        down = isinstance(node, t.Unary) and node.op == "-"
        return function(node.of if down else node, env or self.env), down

    def name(self, i) -> str:
        node = self.nodes[i]
        if isinstance(node, t.Lit) and isinstance(node.value, str):
            return node.value
        if isinstance(node, t.Lambda):
            node = node.body
        if isinstance(node, (t.Name, t.Field)):
            return node.name
        raise QueryError("needs the name of a field")

    def names(self):
        return [(self.name(i), self.name(i)) for i in range(self.count)] + [(k, n.value if isinstance(n, t.Lit) else n.name) for k, n in self.named_nodes.items()]

    def shape(self, env=None):
        return [(self.name(i), function(n, env or self.env)) for i, n in enumerate(self.nodes)] + [(k, function(n, env or self.env)) for k, n in self.named_nodes.items()]

    def entry_names(self, i):
        return [e.key for e in self.nodes[i].entries]

    def entries(self, i):
        return {e.key: as_c(evaluate(e.value, self.env), self.env) for e in self.nodes[i].entries}

    def fields(self) -> set[str]:
        """Fields of the current item that the arguments mention."""
        found = set()

        def walk(n):
            if isinstance(n, t.Lambda):
                return
            if isinstance(n, t.Field) and isinstance(n.of, t.Current):
                found.add(n.name)
            elif isinstance(n, t.Name) and n.name not in self.env.vars:
                found.add(n.name)
            elif isinstance(n, t.Node):
                for v in vars(n).values():
                    for x in v if isinstance(v, tuple) else (v,):
                        if isinstance(x, t.Node):
                            walk(x)

        for n in self.nodes:
            walk(n)
        return found


def function(node, env: Env):
    """A function of one or two values: a lambda, or an expression of ``@``."""
    if isinstance(node, t.Name) and isinstance(env.vars.get(node.name), Closure):
        c = env.vars[node.name]
        node, env = c.node, c.env
    if isinstance(node, t.Lambda) and node.params:
        def call(*values):
            inner = env
            for name, v in zip(node.params, values, strict=False):
                inner = inner.let(name, v)
            return as_c(evaluate(node.body, inner.at(values[0])), inner)

        return call
    body = node.body if isinstance(node, t.Lambda) else node
    return lambda *values: as_c(evaluate(body, env.at(values[0])), env)


def as_c(value, env: Env) -> C:
    """A value as a Column of the rows at hand."""
    if isinstance(value, C):
        return value
    if isinstance(value, Rel):
        if value.single:
            return env.scope.single(value)
        if value.keyed:
            value = pairs_map(value)
            return env.scope.single(value)
        got = gathered(value)
        return env.scope.single(Rel(value.df.agg(got.col.alias("value")), None, single=True))
    if isinstance(value, Grp):
        return group_array(value)
    if isinstance(value, Corr):
        return looked_up(value, group_array(value.grp), env)
    if isinstance(value, Grouped):
        return as_c(from_grouped(value), env)
    if isinstance(value, Doc):
        if value.row is not None:
            return value.row
        raise QueryError("the document as a whole is not a value here")
    raise QueryError("a function is not a value here")


def pairs_map(rel: Rel) -> Rel:
    e = rel.elem
    v = {n: c for n, c in e.parts.items() if n != "key"}
    value = v["value"] if list(v) == ["value"] else struct_of(v)
    m = F.map_from_entries(F.collect_list(F.struct(e.parts["key"].col.alias("key"), whole(value).alias("value"))))
    return Rel(rel.df.agg(m.alias("value")), None, single=True)


def group_array(g: Grp) -> C:
    got = gathered(g.rel, g.cond, g.elem)
    if g.distinct:
        return BUILTINS["unique"](got, _NoArgs)
    return got


class _NoArgs:
    count, trying = 0, False


def looked_up(corr: Corr, agg: C, env: Env, empty: C | None = None) -> C:
    rel, key = corr.grp.rel, corr.key
    if corr.theta is None:
        got = env.scope.aggregate(rel.df, whole(key), whole(corr.outer).cast(key.t), whole(agg), agg.t)
    else:
        # each value of the current rows once, with the rows that pass its test
        name = fresh("c")
        outer = outer_struct(corr.theta)
        met = env.scope.df.select(outer.alias(name + "k")).distinct().join(rel.df, corr.theta.test(column(name + "k")))
        got = env.scope.lookup(met.groupBy(name + "k").agg(whole(agg).alias(name)), outer, name, agg.t)
    return got if empty is None else C(F.coalesce(got.col, whole(empty).cast(agg.t)), agg.t)


def outer_struct(theta: Theta):
    return F.struct(*[whole(c).alias(n) for n, c in theta.outers.items()])


# expressions


def evaluate(node, env: Env):
    return EVAL[type(node)](node, env)


EVAL = {}


def rule(kind_):
    def add(f):
        EVAL[kind_] = f
        return f

    return add


def ec(node, env) -> C:
    return as_c(evaluate(node, env), env)


rule(t.Lit)(lambda n, env: NULL if n.value is None else lit(n.value))
rule(t.Root)(lambda n, env: env.doc)
rule(t.Current)(lambda n, env: env.here)
rule(t.Lambda)(lambda n, env: Closure(n, env))


@rule(t.Name)
def name(n, env):
    if n.name in env.vars:
        return env.vars[n.name]
    here = env.here
    listy = isinstance(here, (Rel, Grp, Corr)) or isinstance(here, C) and kind(here.t) in ("array", "string")
    if listy and n.name in METHODS:
        return call_method(here, n.name, (), (), env)
    return get_field(here, n.name, env)


def get_field(of, name, env):
    if isinstance(of, Doc):
        if name in of.tables:
            return of.tables[name]
        return of.row.field(name) if of.row is not None else NULL
    if isinstance(of, Rel) and of.single:
        c = of.elem.field(name)
        return NULL if kind(c.t) == "null" else of.select(c)
    if isinstance(of, Rel) and of.keyed:
        return key_lookup(of, lit(name), env)
    if isinstance(of, (Rel, Grp)):
        return NULL
    if isinstance(of, Grouped):
        return get_field(from_grouped(of), name, env)
    return as_c(of, env).field(name)


rule(t.Field)(lambda n, env: get_field(evaluate(n.of, env), n.name, env))


@rule(t.Index)
def index(n, env):
    of = evaluate(n.of, env)
    if isinstance(of, Grouped):
        of = from_grouped(of)
    at = ec(n.at, env)
    if isinstance(of, Doc) and isinstance(at.lit, str):
        return get_field(of, at.lit, env)
    if isinstance(of, Rel) and of.keyed:
        return key_lookup(of, at, env)
    if isinstance(of, Rel) and isinstance(at.lit, int):
        return rel_nth(of, at.lit)
    if isinstance(of, Corr) and at.lit == 0:
        return call_method(of, "first", (), (), env)
    c = as_c(of, env)
    if kind(at.t) == "string":
        if isinstance(at.lit, str):
            return c.field(at.lit)
        if isinstance(c.t, T.MapType):
            return C(F.try_element_at(c.col, at.col), c.t.valueType)
        if isinstance(c.t, T.StructType):
            vt = common([f.dataType for f in c.t.fields])
            out = F.lit(None).cast(vt)
            for f in c.t.names:
                out = F.when(at.col == f, cast(c.field(f), vt).col).otherwise(out)
            return C(out, vt)
        return NULL
    if kind(c.t) == "array" and kind(at.t) == "number":
        from ..functions.arrays import pick
        return pick(C(whole(c), c.t), at.col)
    if kind(c.t) == "variant" and isinstance(at.lit, int):
        return C(F.try_variant_get(c.col, f"$[{at.lit}]", "variant"), c.t)
    return NULL


def key_lookup(rel: Rel, at: C, env: Env) -> C:
    """The value of a key of an object made from a table: a left join."""
    name = fresh("l")
    parts = {n: c for n, c in rel.elem.parts.items() if n != "key"}
    value = parts["value"] if list(parts) == ["value"] else struct_of(parts)
    table = rel.df.select(column("key").alias(name + "k"), whole(value).alias(name))
    return env.scope.lookup(table, display(at), name, value.t)


@rule(t.Slice)
def slice_(n, env):
    of = evaluate(n.of, env)
    a, z = (None if x is None else ec(x, env) for x in (n.start, n.stop))
    if isinstance(of, Rel) and not of.single:
        lo, hi = (0 if a is None else a.lit), (None if z is None else z.lit)
        if not isinstance(lo, int) or lo < 0 or hi is not None and (not isinstance(hi, int) or hi < 0):
            raise QueryError("a slice of a table needs bounds that are not negative")
        out = rel_skip(of, lo) if lo else of
        return out if hi is None else rel_take(out, max(0, hi - lo))
    c = as_c(of, env)
    if kind(c.t) != "array":
        return NULL
    from ..functions.arrays import sub
    return sub(C(whole(c), c.t), a and a.col, z and z.col)


@rule(t.Wild)
def wild(n, env):
    of = evaluate(n.of, env)
    return of if n.cond is None else call_method(of, "filter", (n.cond,), (), env)


@rule(t.Where)
def where(n, env):
    of = evaluate(n.of, env)
    if isinstance(of, C) and kind(of.t) not in ("array", "variant"):
        of = array_of([of])
    return call_method(of, "filter", (n.pred,), (), env)


@rule(t.ExactlyOne)
def exactly_one(n, env):
    of = evaluate(n.of, env)
    if isinstance(of, Rel) and not of.single:
        one = of.df.limit(2).agg(F.count("*").alias("n"), F.first(whole(of.elem), ignorenulls=False).alias("v"))
        v = F.when(F.col("n") == 1, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("exactly one element expected, not "), F.col("n").cast("string"))).cast(of.elem.t))
        got = one.select(v.alias("value"))
        c = C(F.col("value"), of.elem.t)
        return Rel(got, None, single=True).select(c)
    c = as_c(of, env)
    if kind(c.t) != "array":
        return c
    x = whole(c)
    return C(F.when(F.size(x) == 1, F.get(x, 0)).otherwise(F.raise_error(F.lit("exactly one element expected")).cast(c.t.elementType)), c.t.elementType)


@rule(t.Deep)
def deep(n, env):
    of = evaluate(n.of, env)
    if isinstance(of, Doc):
        return deep_tables(of, lambda c: paths.named(c, n.name), n.name, env)
    if isinstance(of, Rel) and not of.single:
        return rel_flat(of, lambda e: paths.named(e, n.name), env)
    return paths.named(as_c(of, env), n.name)


def deep_tables(doc: Doc, f, needed, env):
    """Descent into every table, as one relation; tables whose shape has
    nothing to give are not read."""
    found = []
    for rel in doc.tables.values():
        probe = f(rel.elem)
        if kind(probe.t.elementType) != "null":
            found.append(rel_flat(rel, f, env))
    if doc.row is not None:
        c = f(doc.row)
        if kind(c.t.elementType) != "null":
            if not found:
                return c
            found.append(Rel(env.scope.df.select(F.explode(c.col).alias("value")), None))
    if not found:
        return C(F.array(), T.ArrayType(T.NullType()))
    return found[0] if len(found) == 1 else rel_concat([Rel(r.df, r.names) for r in found])


def arithmetic(op, a: C, b: C, trying: bool) -> C:
    a, b = (numeric(x) if kind(x.t) == "variant" else x for x in (a, b))
    ka, kb = kind(a.t), kind(b.t)
    if op == "+" and ka == kb == "string":
        return C(F.concat(a.col, b.col), STRING)
    if op == "+" and ka == kb == "array":
        ty = T.ArrayType(common([a.t.elementType, b.t.elementType]))
        return C(F.concat(cast(a, ty).col, cast(b, ty).col), ty)
    if op == "/":
        if kb != "number":
            if trying:
                return NULL
            raise QueryError(f"cannot divide by {kb}")
        x = a.col.cast("double") if ka == "number" else F.lit(0.0)
        return C(F.try_divide(x, b.col.cast("double")) if trying else x / b.col.cast("double"), DOUBLE)
    if ka != "number" or kb != "number":
        if trying:
            return NULL
        raise QueryError(f"{op} of {ka} and {kb}")
    ty = LONG if is_int(a.t) and is_int(b.t) else T.DoubleType() if any(isinstance(x.t, (T.DoubleType, T.FloatType)) or is_int(x.t) for x in (a, b)) else None
    x, y = (a.col.cast(ty), b.col.cast(ty)) if ty else (a.col, b.col)
    if trying:
        got = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op](x, y)
    else:
        got = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % y}[op]()
    return C(got, ty or DOUBLE) if ty else C(got.cast("double"), DOUBLE)


@rule(t.Binary)
def binary(n, env):
    if n.op == "and":
        a, b = ec(n.left, env), ec(n.right, env)
        return C(truthy(a) & truthy(b), BOOL, keep=kept(a) & kept(b))
    a, b = ec(n.left, env), ec(n.right, env)
    if n.op == "or":
        if kind(a.t) == kind(b.t) == "bool":
            return C(truthy(a) | whole(b), BOOL, keep=kept(a) | kept(b)) if a.lit is ... or b.lit is ... else lit(a.lit or b.lit)
        ty = common([a.t, b.t])
        return C(F.when(truthy(a), cast(a, ty).col).otherwise(cast(b, ty).col), ty)
    if n.op == "??":
        return coalesce([a, b])
    if n.op == "==":
        return C(equal(a, b), BOOL)
    if n.op == "!=":
        return C(~equal(a, b), BOOL)
    if n.op in ("<", "<=", ">", ">="):
        plain = kind(a.t) == kind(b.t) and kind(a.t) in ("number", "string", "bool", "other")
        return C(order(n.op, a, b), BOOL, keep=bare_order(n.op, a, b) if plain else None)
    if n.op == "~=":
        if kind(a.t) != "string" or kind(b.t) != "string":
            return lit(False)
        x, y = F.lower(a.col), F.lower(b.col)
        return C(F.coalesce(F.contains(x, y) | F.contains(y, x), F.lit(False)), BOOL)
    return arithmetic(n.op, a, b, env.trying)


@rule(t.Unary)
def unary(n, env):
    c = ec(n.of, env)
    if n.op == "not":
        return C(~truthy(c), BOOL)
    if kind(c.t) == "variant":
        c = numeric(c)
    if kind(c.t) != "number":
        raise QueryError(f"- of {kind(c.t)}")
    return C(-c.col, c.t)


rule(t.KindTest)(lambda n, env: (lambda c: C(~c.col, BOOL) if n.negated else c)(kind_test(ec(n.of, env), n.kind)))
rule(t.Cast)(lambda n, env: convert(ec(n.of, env), n.to, env.trying))


@rule(t.If)
def if_(n, env):
    a, b = ec(n.then, env), ec(n.other, env)
    ty = common([a.t, b.t])
    if isinstance(ty, T.NullType):
        return NULL
    return C(F.when(truthy(ec(n.cond, env)), cast(a, ty).col).otherwise(cast(b, ty).col), ty)


@rule(t.Try)
def try_(n, env):
    other = ec(n.other, env)
    try:
        body = ec(n.body, replace(env, trying=True))
    except QueryError:
        return other
    return coalesce([body, other])


@rule(t.Let)
def let(n, env):
    value = evaluate(n.value, env)
    if isinstance(value, Rel) and value.single and isinstance(env.here, C):
        value = as_c(value, env)
    return evaluate(n.body, env.let(n.name, value))


@rule(t.Pipe)
def pipe(n, env):
    left = evaluate(n.left, env)
    if isinstance(n.left, t.Bind):
        return evaluate(n.right, bound(n.left, left, env))
    return piped(left, n.right, env)


def piped(left, right, env):
    if isinstance(right, t.Name):
        if isinstance(env.vars.get(right.name), Closure):
            return function(right, env)(as_c(left, env))
        if right.name in METHODS and right.name not in env.vars:
            return call_method(left, right.name, (), (), env)
    if isinstance(right, t.Call) and right.of is None and right.name in METHODS:
        return call_method(left, right.name, right.args, right.named, env)
    if isinstance(right, t.Lambda):
        return function(right, env)(as_c(left, env))
    return evaluate(right, env.at(left))


def bound(n: t.Bind, value, env):
    how, names = n.names
    if how == "name":
        return env.let(names, value).at(value)
    c = as_c(value, env)
    for i, x in enumerate(names):
        env = env.let(x, c.field(x) if how == "fields" else C(F.get(whole(c), i), c.t.elementType))
    if n.rest:
        env = env.let(n.rest, struct_of({k: c.field(k) for k in c.t.names if k not in names}))
    return env.at(c)


@rule(t.Bind)
def bind(n, env):
    value = evaluate(n.left, env)
    if n.body is None:
        return value
    inner = bound(n, value, env)
    return piped(value, n.body, inner) if n.names[0] == "name" else evaluate(n.body, inner)


@rule(t.Array)
def array(n, env):
    spread = n.spreads or (False,) * len(n.items)
    items = [evaluate(x, env) for x in n.items]
    if any(s and isinstance(x, Rel) and not x.single for x, s in zip(items, spread, strict=True)):
        return rel_concat([x if s else one_row(as_c(x, env), env) for x, s in zip(items, spread, strict=True)])
    items = [as_c(x, env) for x in items]
    if not any(spread):
        return array_of(items)
    parts = [x if s else array_of([x]) for x, s in zip(items, spread, strict=True)]
    ty = T.ArrayType(common([p.t.elementType for p in parts]))
    return C(F.concat(*[cast(p, ty).col for p in parts]), ty)


def one_row(c: C, env) -> Rel:
    return Rel(env.scope.df.select(whole(c).alias("value")), None, single=True).select(C(F.col("value"), c.t))


@rule(t.Object)
def object_(n, env):
    out, dynamic = {}, []
    for e in n.entries:
        if e.spread:
            c = as_c(evaluate(e.value, env), env)
            if kind(c.t) == "null":
                continue
            if e.spread == "deep":
                out = dict(merged(struct_of(out), c, deep=True, lists=True).parts)
            else:
                out |= {k: c.field(k) for k in c.t.names}
            continue
        value = ec(e.value, env)
        if e.cond is not None:
            value = C(F.when(truthy(ec(e.cond, env)), whole(value)), value.t) if kind(value.t) != "null" else value
        value = replace(value, drop=e.optional or e.cond is not None)
        if value.drop and kind(value.t) == "null":
            continue
        if isinstance(e.key, str):
            out[e.key] = value
            continue
        key = ec(e.key, env)
        if isinstance(key.lit, str):
            out[key.lit] = value
        else:
            dynamic.append((key, value))
    if not dynamic:
        return struct_of(out)
    ty = common([v.t for v in out.values()] + [v.t for _, v in dynamic])
    parts = [x for k, v in out.items() for x in (F.lit(k), cast(v, ty).col)] + [x for k, v in dynamic for x in (display(k), cast(v, ty).col)]
    return C(F.create_map(*parts), T.MapType(STRING, ty))


@rule(t.FString)
def fstring(n, env):
    parts = []
    for p in n.parts:
        if isinstance(p, str):
            parts.append(F.lit(p))
            continue
        node, fmt, pipe_ = p
        value = evaluate(node, env)
        if pipe_:
            value = call_method(value, pipe_, (), (), env)
        parts.append(formatted(as_c(value, env), fmt))
    return C(F.concat(*parts) if parts else F.lit(""), STRING)


def formatted(c: C, fmt: str | None) -> Column:
    import re
    text = display(c)
    if not fmt:
        return text
    m = re.fullmatch(r"\.(\d+)f", fmt)
    if m and kind(c.t) == "number":
        return F.format_string(f"%.{m[1]}f", c.col.cast("double"))
    if fmt == "d" and kind(c.t) == "number":
        return c.col.cast("bigint").cast("string")
    m = re.fullmatch(r"([<>^0])(\d+)", fmt)
    if m:
        short = F.greatest(F.lit(int(m[2])) - F.char_length(text), F.lit(0))
        pad = lambda k, ch=" ": F.repeat(F.lit(ch), k)
        left = F.floor(short / 2).cast("int")
        return {"<": F.concat(text, pad(short)), ">": F.concat(pad(short), text), "0": F.concat(pad(short, "0"), text), "^": F.concat(pad(left), text, pad(short - left))}[m[1]]
    return text


@rule(t.Comprehension)
def comprehension(n, env):
    source = evaluate(n.source, env)
    if isinstance(source, Grouped):
        source = from_grouped(source)
    if len(n.names) == 2:
        if isinstance(source, Rel) and source.keyed:
            parts = {k: c for k, c in source.elem.parts.items() if k != "key"}
            value = parts["value"] if list(parts) == ["value"] else struct_of(parts)
            scope = Scope(source.df)
            inner = env.let(n.names[0], source.elem.parts["key"]).let(n.names[1], value).at(value, scope)
            return comprehend(n, source, inner, scope)
        c = as_c(source, env)
        if kind(c.t) == "object":
            source = BUILTINS["to_pairs"](c, _NoArgs)
            get = lambda x: {n.names[0]: x.field("key"), n.names[1]: x.field("val")}
        else:
            source = BUILTINS["enumerate"](c, _NoArgs)
            get = lambda x: {n.names[0]: x.field("index"), n.names[1]: x.field("value")}
    else:
        get = lambda x: {n.names[0]: x}
    if isinstance(source, Rel) and not source.single:
        scope = Scope(source.df)
        e = source.elem
        inner = env.at(e, scope)
        for k, v in get(e).items():
            inner = inner.let(k, v)
        return comprehend(n, source, inner, scope)
    c = as_c(source, env)
    if kind(c.t) in ("object",):
        c = BUILTINS["to_pairs"](c, _NoArgs)
    if kind(c.t) != "array":
        c = array_of([c])

    def inner(x):
        e = env.at(x)
        for k, v in get(x).items():
            e = e.let(k, v)
        return e

    et = c.t.elementType
    col = whole(c)
    if n.cond is not None:
        col = F.filter(col, lambda x: truthy(ec(n.cond, inner(C(x, et)))))
    from ..functions.arrays import _last_wins, hof
    c = C(col, c.t)
    if n.kind == "dict":
        seen = []

        def pair(x):
            k, v = (ec(y, inner(C(x, et))) for y in n.item)
            seen.append(v.t)
            return F.struct(display(k).alias("key"), whole(v).alias("value"))

        pairs = F.transform(col, pair)
        return _last_wins(pairs, seen[0])
    got, ty = hof(F.transform, c, lambda x: ec(n.item, inner(x)))
    if n.kind == "flat":
        return C(F.flatten(got), ty)
    out = C(got, T.ArrayType(ty))
    return BUILTINS["unique"](out, _NoArgs) if n.kind == "set" else out


def comprehend(n, source: Rel, inner: Env, scope: Scope):
    if n.cond is not None:
        cond = truthy(ec(n.cond, inner))
        scope.df = scope.df.where(cond)
    if n.kind == "dict":
        k, v = (ec(x, inner) for x in n.item)
        rel = source.select(struct_of({"key": C(display(k), STRING), "value": v}), scope.df, keyed=False)
        return rel_index(rel, rel.elem.field("key"), rel.df, value=["value"])
    if n.kind == "flat":
        return flat_items(n.item, source, inner, scope)
    out = source.select(ec(n.item, inner), scope.df, keyed=False)
    return rel_unique(out) if n.kind == "set" else out


def flat_items(item: t.Comprehension, source: Rel, inner: Env, scope: Scope):
    """The inner clause of a comprehension over a table: a join with the inner
    table on its condition, or an array of each row."""
    below = evaluate(item.source, inner)
    if isinstance(below, (Rel, Corr)) and len(item.names) == 1 and item.kind == "list":
        other = below if isinstance(below, Rel) else below.grp.rel
        outer = source.on(scope.df)
        held = {k: fresh("f") for k in outer.df.columns}
        tag = {k: fresh("g") for k in other.df.columns}
        df = outer.df.select(*[column(k).alias(v) for k, v in held.items()])
        right = other.df.select(*[column(k).alias(v) for k, v in tag.items()])
        on = F.lit(True)
        if isinstance(below, Corr) and below.theta is not None:
            # the test joins the tables; their values are renamed after it
            k = fresh("t")
            df = outer.df.select("*", outer_struct(below.theta).alias(k)).select(*[column(c).alias(v) for c, v in held.items()], k)
            df = df.join(other.df, below.theta.test(column(k))).select(*held.values(), *[column(c).alias(v) for c, v in tag.items()])
        elif isinstance(below, Corr):
            on = renamed(below.key, tag).eqNullSafe(renamed(below.outer, held))
        e = renamed_c(other.elem, tag)
        here = replace(inner, vars={k: renamed_c(v, held) if isinstance(v, C) else v for k, v in inner.vars.items()}).let(item.names[0], e)
        if not (isinstance(below, Corr) and below.theta is not None):
            df = df.join(right, on)
        rows = Scope(df)
        here = here.at(e, rows)
        if item.cond is not None:
            rows.df = rows.df.where(truthy(ec(item.cond, here)))
        order = [(held[k], d) for k, d in source.order] + [(tag[k], d) for k, d in other.order] if source.order and other.order else []
        return Rel(rows.df, None, order).select(ec(item.item, here))
    c = ec(item, inner)
    return rel_flat(source.on(scope.df), lambda e: c)


def renamed_c(c: C, names: dict) -> C:
    """A value of columns that have other names now."""
    if c.parts is not None:
        return struct_of({k: renamed_c(v, names) for k, v in c.parts.items()})
    if c.lit is not ... or c.col is None:
        return c
    return C(renamed(c, names), c.t)


def renamed(c: C, names: dict) -> Column:
    sql = c.col._jc.toString()
    bare = sql.strip("`")
    if bare in names:
        return column(names[bare])
    raise QueryError("a further clause can use fields of the one before it, not expressions of them, in its source")


@rule(t.Patch)
def patch(n, env):
    target = evaluate(n.target, env)
    if isinstance(target, Doc):
        return patch_doc(target, n.ops, env)
    if isinstance(target, Rel) and not target.single:
        raise QueryError("patch a table through the document: $.table[*]...")
    c = as_c(target, env)
    root = c
    for op in n.ops:
        c = write(c, op, env.at(root), c)
    return c


def written(op: t.Op, env: Env):
    """An op's value: a C, a function of what is there, or None to delete."""
    if op.value is None:
        return None
    if isinstance(op.value, t.Lambda):
        return function(op.value, env)
    return ec(op.value, env)


def path_steps(path, env):
    out = []
    for how, x in path:
        if how == "field":
            out.append(x)
        elif how == "index":
            c = ec(x, env)
            out.append(c.lit if isinstance(c.lit, int) else c.col)
        elif how == "wild":
            out.append(("wild", None if x is None else function(x, env)))
        else:
            out.append(("deep", x))
    return out


def write(c: C, op: t.Op, env: Env, now: C) -> C:
    when = None if op.cond is None else truthy(ec(op.cond, env))
    return paths.put(c, path_steps(op.path, env.at(now)), written(op, env), when)


def patch_doc(doc: Doc, ops, env: Env):
    """Writes to tables make new relations; the others stay as they are. The
    guards read the document before the writes."""
    tables, row = dict(doc.tables), doc.row
    changed = []
    for op in ops:
        how, first = op.path[0]
        if how != "field" or first not in tables:
            if row is None:
                raise QueryError("no such table to write to")
            row = write(row, op, env.at(doc), row)
            continue
        rel, rest = tables[first], op.path[1:]
        changed.append(first)
        scope = Scope(rel.df)
        e = rel.elem
        inner = env.at(e, scope)
        when = None if op.cond is None else truthy(ec(op.cond, env.at(doc, scope)))
        if not rest:
            if op.value is None:
                tables.pop(first)
            else:
                tables[first] = evaluate(op.value, env)
            continue
        how, cond = rest[0]
        if how == "deep":
            out = paths.put(e, path_steps(rest, inner), written(op, inner), when)
            tables[first] = rel.select(out, scope.df)
            continue
        if how == "index":
            at = ec(cond, env).lit
            rel = rel_positions(rel)
            scope = Scope(rel.df)
            e = struct_of({k: v for k, v in rel.elem.parts.items()})
            inner = env.at(e, scope)
            test = F.col("__pos") == at
        elif how == "wild":
            test = None if cond is None else truthy(function(cond, inner)(e))
        else:
            raise QueryError("a table is written by [*], [* if ...] or [n]")
        if when is not None:
            test = when if test is None else test & when
        if len(rest) == 1 and op.value is None:
            tables[first] = rel.on(scope.df.where(F.lit(False) if test is None else ~test))
        else:
            out = paths.put(e, path_steps(rest[1:], inner), written(op, inner), test)
            tables[first] = rel.select(out, scope.df)
    out = Doc(tables, row)
    out.changed = list(dict.fromkeys(changed))
    return out


# calls

METHODS: dict[str, object] = {}
REL: dict[str, object] = {}


@rule(t.Call)
def call(n, env):
    if n.of is None:
        if isinstance(env.vars.get(n.name), Closure):
            c = env.vars[n.name]
            values = [as_c(evaluate(a, env), env) for a in n.args]
            return function(c.node, c.env)(*values)
        if n.name in FREE:
            return FREE[n.name](n, env)
        if not n.args:
            return call_method(env.here, n.name, (), n.named, env)
        return call_method(evaluate(n.args[0], env), n.name, n.args[1:], n.named, env)
    of = evaluate(n.of, env)
    return call_method(of, n.name, n.args, n.named, env)


def call_method(of, name, args, named, env):
    if isinstance(of, Grouped):
        if name == "transform_values":
            return rel_shape(of, Args(args, named, env))
        if name in ("len", "count"):
            return rel_scalar(of.scope.df.agg(F.count_distinct(display(of.key)).alias("value")))
        of = from_grouped(of)
    if isinstance(of, Doc) and name.startswith("deep_"):
        a = Args(args, named, env)
        return deep_tables(of, lambda c: BUILTINS[name](c, a), None, env)
    if isinstance(of, Corr):
        return corr_call(of, name, args, named, env)
    if isinstance(of, Grp):
        return group_call(of, name, Args(args, named, env))
    if isinstance(of, Rel) and of.single and name == "collect":
        return of
    if isinstance(of, Rel) and not of.single:
        if name in REL:
            return REL[name](of, Args(args, named, env))
        if name in BUILTINS:  # as one array; what has a relational form has it
            return BUILTINS[name](as_c(of, env), Args(args, named, env))
        raise QueryError(f"no function {name!r}")
    if isinstance(of, Closure):
        raise QueryError("a function has no methods")
    if name not in BUILTINS:
        raise QueryError(f"no function {name!r}")
    c = as_c(of, env)
    inner = env
    return BUILTINS[name](c, Args(args, named, inner))


FREE = {}
from . import methods  # noqa: E402  (registers the methods of tables and groups)

from_grouped, corr_call, group_call, rel_shape = methods.from_grouped, methods.corr_call, methods.group_call, methods.rel_shape
rel_nth, rel_take, rel_skip, rel_flat, rel_concat = methods.rel_nth, methods.rel_take, methods.rel_skip, methods.rel_flat, methods.rel_concat
rel_index, rel_unique, rel_scalar, rel_positions = methods.rel_index, methods.rel_unique, methods.rel_scalar, methods.rel_positions
METHODS.update({n: True for n in [*BUILTINS, *REL]})
