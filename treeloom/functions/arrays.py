"""Builtins on arrays inside a row, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import BOOL, BUILTINS, DOUBLE, LONG, NULL, STRING, C, QueryError, array_of, builtin, cast, common, display, dropped, equal, hof, is_int, kind, lit, numeric, order, struct_of, truthy, whole


def held(c: C, f) -> C:
    """``f`` of a value that is made once. A Column named inside a lambda is
    otherwise made again for each element: a group would be sorted as often as
    it has rows."""
    seen = []

    def run(x):
        got = f(C(x, c.t))
        seen.append(got.t)
        return whole(got)

    col = F.get(F.transform(F.array(whole(c)), run), F.lit(0))
    return C(col, seen[0])


def array(*names, other=None, again=False):
    """A builtin of an array; on other kinds ``other`` or the receiver. One
    that names the array inside a lambda (``again``) gets it held."""
    def add(f):
        def run(c, a):
            if kind(c.t) == "variant":
                c = C(F.try_variant_get(c.col, "$", "array<variant>"), T.ArrayType(T.VariantType()))
            if kind(c.t) != "array":
                return c if other is None else other(c, a)
            return held(c, lambda x: f(x, a)) if again else f(C(whole(c), c.t), a)

        builtin(*names)(run)
        return f

    return add


def wrong(name):
    def fail(c, a):
        raise QueryError(f"{name} needs an array, not {kind(c.t)}")

    return fail


def elem(c):
    return c.t.elementType


def keyed(c: C):
    """The array as the display text of its elements."""
    return F.transform(c.col, lambda x: display(C(x, elem(c))))


def preds(a):
    fns = [a.fn(i) for i in range(a.count)]

    def both(x):
        got = truthy(fns[0](x))
        for f in fns[1:]:
            got = got & truthy(f(x))
        return C(got, BOOL)

    return both


def sequence(n):
    """Positions 0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def pick(c: C, i):
    """Element at a position, negative from the end, never before the first."""
    n = F.size(c.col)
    return C(F.get(c.col, F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(i).cast("int")), elem(c))


def sub(c: C, start, stop):
    """Half-open, clamped; bounds are Columns or None, negative from the end."""
    n = F.size(c.col)
    at = lambda i: F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n))
    a = F.lit(0) if start is None else at(start)
    z = n if stop is None else at(stop)
    return C(F.slice(c.col, (a + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int")), c.t)


@array("filter", "find", "find_all", other=wrong("filter"))
def filter_(c, a):
    if not a.count:
        raise QueryError("find needs a predicate")
    return C(hof(F.filter, c, preds(a))[0], c.t)


@array("find_first", "find_one", other=wrong("find_first"))
def find_first(c, a):
    return C(F.get(filter_(c, a).col, 0), elem(c))


array("compact")(lambda c, a: C(F.filter(c.col, lambda x: x.isNotNull()), c.t))


@array("remove")
def remove(c, a):
    if a.is_fn(0):
        f = a.fn(0)
        return C(F.filter(c.col, lambda x: ~truthy(f(C(x, elem(c))))), c.t)
    v = display(a.val(0))
    return C(F.filter(c.col, lambda x: display(C(x, elem(c))) != v), c.t)


@array("map", other=wrong("map"))
def map_(c, a):
    col, t = hof(F.transform, c, a.fn(0))
    return C(col, T.ArrayType(t))


@array("flat_map", other=wrong("flat_map"))
def flat_map(c, a):
    col, t = hof(F.transform, c, a.fn(0))
    if isinstance(t, T.ArrayType):
        return C(F.flatten(col), t)
    return C(col, T.ArrayType(t))


@array("flatten")
def flatten(c, a):
    for _ in range(int(a.val(0).lit) if a.count else 1):
        if isinstance(elem(c), T.ArrayType):
            c = C(F.flatten(F.filter(c.col, lambda x: x.isNotNull())), elem(c))
    return c


@array("enumerate", other=wrong("enumerate"))
def enumerate_(c, a):
    t = T.StructType([T.StructField("index", LONG), T.StructField("value", elem(c))])
    return C(F.transform(c.col, lambda x, i: F.struct(i.cast("long").alias("index"), x.alias("value"))), T.ArrayType(t))


@array("pairwise")
def pairwise(c, a):
    return C(F.zip_with(F.slice(c.col, F.lit(1), F.greatest(F.size(c.col) - 1, F.lit(0))), F.slice(c.col, F.lit(2), F.greatest(F.size(c.col) - 1, F.lit(0))), lambda x, y: F.array(x, y)), T.ArrayType(c.t))


@array("partition")
def partition(c, a):
    f = preds(a)
    no = F.filter(c.col, lambda x: ~f(C(x, elem(c))).col)
    return struct_of({"true": C(hof(F.filter, c, f)[0], c.t), "false": C(no, c.t)})


@builtin("fanout")
def fanout(c, a):
    return array_of([a.fn(i)(c) for i in range(a.count)])


@builtin("zip_shape")
def zip_shape(c, a):
    return struct_of({n: f(c) for n, f in a.shape()})


def size_arg(a, i=0, default=None):
    return a.val(i).col if i < a.count else F.lit(default)


array("take")(lambda c, a: C(F.slice(c.col, F.lit(1), F.greatest(size_arg(a), F.lit(0)).cast("int")), c.t))
array("skip", "drop")(lambda c, a: sub(c, F.greatest(size_arg(a), F.lit(0)), None))


@array("first", other=lambda c, a: NULL)
def first(c, a):
    return C(F.get(c.col, 0), elem(c)) if not a.count else C(F.slice(c.col, F.lit(1), size_arg(a).cast("int")), c.t)


@array("last", other=lambda c, a: NULL)
def last(c, a):
    if not a.count:
        return C(F.try_element_at(c.col, F.lit(-1)), elem(c))
    n = F.size(c.col)
    return sub(c, F.greatest(n - size_arg(a), F.lit(0)), None)


array("nth")(lambda c, a: pick(c, size_arg(a)))


def lead_count(c, f):
    """Length of the leading run of truthy elements."""
    flags = F.transform(c.col, lambda x: truthy(f(C(x, elem(c)))))
    at = F.array_position(flags, False)
    return F.when(at == 0, F.size(c.col)).otherwise(at - 1)


array("take_while", "takewhile")(lambda c, a: sub(c, None, lead_count(c, a.fn(0))))
array("drop_while", "dropwhile")(lambda c, a: sub(c, lead_count(c, a.fn(0)), None))


@array("find_index")
def find_index(c, a):
    f = preds(a)
    at = F.array_position(F.transform(c.col, lambda x: f(C(x, elem(c))).col), True)
    return C(F.nullif(at, F.lit(0).cast("long")) - 1, LONG)


def positions(c, test):
    hits = F.filter(F.transform(c.col, lambda x, i: F.when(test(C(x, elem(c))), i.cast("long"))), lambda i: i.isNotNull())
    return C(hits, T.ArrayType(LONG))


@array("indices_where")
def indices_where(c, a):
    f = preds(a)
    return positions(c, lambda x: f(x).col)


array("indices_of", other=wrong("indices_of"))(lambda c, a: (lambda v: positions(c, lambda x: equal(x, v)))(a.val(0)))
array("index", other=wrong("index"))(lambda c, a: (lambda v: C(F.get(positions(c, lambda x: equal(x, v)).col, 0), LONG))(a.val(0)))


def extreme(c, a, sign):
    f = a.fn(0)
    keys, kt = hof(F.transform, c, f)
    best = F.array_min(keys) if sign < 0 else F.array_max(keys)
    return C(F.get(c.col, (F.array_position(keys, best) - 1).cast("int")), elem(c))


array("max_by")(lambda c, a: extreme(c, a, 1))
array("min_by")(lambda c, a: extreme(c, a, -1))


@array("sort", "sort_by", other=wrong("sort"))
def sort(c, a):
    if a.count == 1 and a.arity(0) == 2:
        less = a.fn(0)

        def compare(x, y):
            x, y = C(x, elem(c)), C(y, elem(c))
            return F.when(truthy(less(x, y)), -1).when(truthy(less(y, x)), 1).otherwise(0)

        return C(F.array_sort(c.col, compare), c.t)
    keys = [a.sort_key(i) for i in range(a.count)] or [(lambda x: x, False)]

    def compare(x, y):
        x, y = C(x, elem(c)), C(y, elem(c))
        got = None
        for f, down in reversed(keys):
            p, q = f(x), f(y)
            lt, gt = order("<", p, q), order(">", p, q)
            null_p, null_q = whole(p).isNull(), whole(q).isNull()
            lt, gt = lt | (null_p & ~null_q), gt | (null_q & ~null_p)
            here = F.when(gt if down else lt, -1).when(lt if down else gt, 1)
            got = here.otherwise(0 if got is None else got)
        return got

    return C(F.array_sort(c.col, compare), c.t)


@builtin("reverse")
def reverse(c, a):
    return C(F.reverse(whole(c)), c.t) if kind(c.t) in ("array", "string") else c


def first_of(c, keys):
    """Elements whose key is the first of its kind."""
    return held(C(keys, T.ArrayType(STRING)), lambda k: C(F.filter(c.col, lambda x, i: F.array_position(k.col, F.get(k.col, i)) == i + 1), c.t))


@array("unique", "distinct", again=True)
def unique(c, a):
    if kind(elem(c)) in ("number", "string", "bool") and not isinstance(elem(c), (T.DoubleType, T.FloatType)):
        return C(F.array_distinct(c.col), c.t)
    return first_of(c, keyed(c))


@array("unique_by", again=True)
def unique_by(c, a):
    f = a.fn(0)
    return first_of(c, F.transform(c.col, lambda x: display(f(C(x, elem(c))))))


def joined(c: C, parts: list[C]) -> tuple[T.DataType, list]:
    t = common([elem(c), *[p.t for p in parts]])
    return t, [cast(c, T.ArrayType(t)).col, *[cast(p, t).col for p in parts]]


@array("append")
def append(c, a):
    t, (x, v) = joined(c, [a.val(0) if a.count else NULL])
    return C(F.array_append(x, v), T.ArrayType(t))


@array("prepend")
def prepend(c, a):
    t, (x, v) = joined(c, [a.val(0) if a.count else NULL])
    return C(F.array_prepend(x, v), T.ArrayType(t))


def other_keys(a):
    o = a.val(0)
    if kind(o.t) != "array":
        raise QueryError("needs an array")
    return C(whole(o), o.t)


@array("diff")
def diff(c, a):
    keys = C(keyed(other_keys(a)), T.ArrayType(STRING))
    return held(keys, lambda k: C(F.filter(c.col, lambda x: ~F.array_contains(k.col, display(C(x, elem(c))))), c.t))


@array("intersect")
def intersect(c, a):
    keys = C(keyed(other_keys(a)), T.ArrayType(STRING))
    return held(keys, lambda k: C(F.filter(c.col, lambda x: F.array_contains(k.col, display(C(x, elem(c))))), c.t))


@array("union")
def union(c, a):
    o, keys = other_keys(a), C(keyed(c), T.ArrayType(STRING))
    t = common([elem(c), elem(o)])
    more = held(keys, lambda k: C(F.filter(o.col, lambda x: ~F.array_contains(k.col, display(C(x, elem(o))))), o.t))
    return C(F.concat(cast(c, T.ArrayType(t)).col, cast(more, T.ArrayType(t)).col), T.ArrayType(t))


@array("join", other=wrong("join"))
def join(c, a):
    sep = a.val(0).col if a.count else F.lit("")
    return C(F.aggregate(keyed(c), F.lit(None).cast("string"), lambda x, y: F.when(x.isNull(), y).otherwise(F.concat(x, sep, y)), lambda x: F.coalesce(x, F.lit(""))), STRING)


def zipped(c, o, fill=None):
    t = common([elem(c), elem(o)] + ([fill.t] if fill else []))
    if isinstance(t, T.NullType):
        t = elem(c)
    at = lambda v, i: F.get(v, i) if fill is None else F.when(i < F.size(v), F.get(v, i)).otherwise(cast(fill, t).col)

    def pairs(x, y):
        total = (F.least if fill is None else F.greatest)(F.size(x), F.size(y))
        return C(F.transform(sequence(total), lambda i: F.array(at(x, i), at(y, i))), T.ArrayType(T.ArrayType(t)))

    return held(cast(c, T.ArrayType(t)), lambda x: held(cast(o, T.ArrayType(t)), lambda y: pairs(x.col, y.col)))


array("zip")(lambda c, a: zipped(c, other_keys(a)))
array("zip_longest")(lambda c, a: zipped(c, other_keys(a), a.named("fill") or NULL))


@array("window", again=True)
def window(c, a):
    n = size_arg(a).cast("int")
    return C(F.transform(sequence(F.size(c.col) - n + 1), lambda i: F.slice(c.col, i + 1, n)), T.ArrayType(c.t))


@array("chunk", "batch", again=True)
def chunk(c, a):
    n = size_arg(a).cast("int")
    return C(F.transform(sequence(F.ceil(F.size(c.col) / n)), lambda i: F.slice(c.col, i * n + 1, n)), T.ArrayType(c.t))


@builtin("includes", "contains")
def includes(c, a):
    v = a.val(0)
    k = kind(c.t)
    if k == "array":
        if kind(elem(C(None, c.t))) == kind(v.t) == "string":
            return C(F.coalesce(F.array_contains(whole(c), v.col), F.lit(False)), BOOL)
        return C(F.coalesce(F.exists(whole(c), lambda x: display(C(x, c.t.elementType)) == display(v)), F.lit(False)), BOOL)
    if k == "string":
        return C(F.coalesce(F.contains(c.col, v.col if kind(v.t) == "string" else F.lit("")), F.lit(False)), BOOL)
    if isinstance(c.t, T.StructType) and not any(map(dropped, c.t.fields)):
        return lit(v.lit in c.t.names) if v.lit is not ... else C(v.col.isin(c.t.names), BOOL)
    if isinstance(c.t, T.StructType):
        return C(F.coalesce(F.array_contains(BUILTINS["keys"](c, a).col, v.col), F.lit(False)), BOOL)
    if isinstance(c.t, T.MapType):
        return C(F.coalesce(F.map_contains_key(c.col, v.col), F.lit(False)), BOOL)
    if k == "variant":
        return C(F.try_variant_get(c.col, f'$["{v.lit}"]', "variant").isNotNull(), BOOL)
    return lit(False)


@builtin("len")
def len_(c, a):
    k = kind(c.t)
    if k == "array" or isinstance(c.t, T.MapType):
        return C(F.size(whole(c)).cast("long"), LONG)
    if k == "string":
        return C(F.char_length(c.col).cast("long"), LONG)
    if isinstance(c.t, T.StructType) and any(map(dropped, c.t.fields)):
        return C(F.size(BUILTINS["keys"](c, a).col).cast("long"), LONG)
    if isinstance(c.t, T.StructType):
        return lit(len(c.t.names))
    if k == "variant":
        as_ = lambda t: F.try_variant_get(c.col, "$", t)
        return C(F.coalesce(F.size(as_("array<variant>")), F.size(as_("map<string,variant>")), F.char_length(as_("string"))).cast("long"), LONG)
    return c


@builtin("count")
def count(c, a):
    if a.count:
        return len_(filter_(c, a), a)
    return len_(c, a)


def values(c, a):
    """The array, or what a projection makes of each element."""
    if not a.count:
        return c
    col, t = hof(F.transform, c, a.fn(0))
    return C(col, T.ArrayType(t))


def numbers(c):
    if kind(elem(c)) == "number":
        return C(F.filter(c.col, lambda x: x.isNotNull()), c.t)
    return C(F.filter(F.transform(c.col, lambda x: numeric(C(x, elem(c))).col), lambda x: x.isNotNull()), T.ArrayType(DOUBLE))


def reducer(name, other=lambda c, a: NULL):
    def add(f):
        array(name, other=other)(lambda c, a: f(numbers(values(c, a))))
        return f

    return add


@reducer("sum")
def sum_(c):
    t = LONG if is_int(elem(c)) else DOUBLE
    return C(F.aggregate(c.col, F.lit(0).cast(t), lambda x, y: x + y.cast(t)), t)


@reducer("avg")
def avg(c):
    return C(F.when(F.size(c.col) > 0, F.aggregate(c.col, F.lit(0.0), lambda x, y: x + y.cast("double")) / F.size(c.col)), DOUBLE)


reducer("min")(lambda c: C(F.array_min(c.col), elem(c)))
reducer("max")(lambda c: C(F.array_max(c.col), elem(c)))
array("approx_count_distinct")(lambda c, a: C(F.size(F.array_distinct(keyed(c))).cast("long"), LONG))
array("any", "exists", other=lambda c, a: lit(False))(lambda c, a: C(F.coalesce(hof(F.exists, c, preds(a))[0], F.lit(False)), BOOL))
array("all", other=lambda c, a: lit(False))(lambda c, a: C(F.coalesce(hof(F.forall, c, preds(a))[0], F.lit(False)), BOOL))


def key_array(c, a):
    f = a.fn(0)
    return F.transform(c.col, lambda x: display(f(C(x, elem(c)))))


def by_key(c, a, make, t):
    def made(ks):
        keys = ks.col
        return C(F.map_from_arrays(F.array_distinct(keys), F.transform(F.array_distinct(keys), lambda k: make(keys, k))), T.MapType(STRING, t))

    return held(C(key_array(c, a), T.ArrayType(STRING)), made)


def rows_of(c, keys, k):
    return F.filter(c.col, lambda x, i: F.get(keys, i) == k)


array("group_by", again=True)(lambda c, a: by_key(c, a, lambda keys, k: rows_of(c, keys, k), c.t))
array("count_by", again=True)(lambda c, a: by_key(c, a, lambda keys, k: F.size(F.filter(keys, lambda x: x == k)).cast("long"), LONG))
array("index_by", again=True)(lambda c, a: by_key(c, a, lambda keys, k: F.element_at(rows_of(c, keys, k), -1), elem(c)))


@array("group_shape", again=True)
def group_shape(c, a):
    f, seen = a.fn(1), []

    def make(keys, k):
        got = f(C(rows_of(c, keys, k), c.t))
        seen.append(got.t)
        return whole(got)

    got = by_key(c, a, make, c.t)
    return C(got.col, T.MapType(STRING, seen[0]))


@array("accumulate")
def accumulate(c, a):
    f = a.fn(0)
    t = common([f(C(F.lit(None).cast(elem(c)), elem(c)), C(F.lit(None).cast(elem(c)), elem(c))).t, elem(c)])

    def step(acc, x):
        return F.when(F.size(acc) == 0, F.array(x.cast(t))).otherwise(F.concat(acc, F.array(whole(f(C(F.element_at(acc, -1), t), C(x, elem(c)))).cast(t))))

    return C(F.aggregate(c.col, F.array().cast(T.ArrayType(t)), step), T.ArrayType(t))


def analytic(*names):
    """A window function over the doubles of an array: of position, array and
    the argument."""
    def add(f):
        def run(c, a):
            xs = F.transform(c.col, lambda x: numeric(C(x, elem(c))).col)
            n = int(a.val(0).lit) if a.count else 1
            if n < 1:
                raise QueryError(f"{names[0]} needs a positive size")
            return held(C(xs, T.ArrayType(DOUBLE)), lambda v: C(f(v.col, n), v.t))

        array(*names, other=wrong(names[0]))(run)
        return f

    return add


def rolled(f):
    def run(xs, n):
        def at(x, i):
            part = F.filter(F.slice(xs, F.greatest(i - n + 2, F.lit(1)), F.least(i + 1, F.lit(n))), lambda v: v.isNotNull())
            return F.when(i >= n - 1, f(part))

        return F.transform(xs, at)

    return run


def total(part):
    return F.aggregate(part, F.lit(0.0), lambda x, y: x + y)


analytic("rolling_sum")(rolled(total))
analytic("rolling_avg")(rolled(lambda p: F.when(F.size(p) > 0, total(p) / F.size(p))))
analytic("rolling_min")(rolled(F.array_min))
analytic("rolling_max")(rolled(F.array_max))
analytic("lag")(lambda xs, n: F.transform(xs, lambda x, i: F.get(xs, i - n)))
analytic("lead")(lambda xs, n: F.transform(xs, lambda x, i: F.get(xs, i + n)))
analytic("diff_window")(lambda xs, n: F.transform(xs, lambda x, i: x - F.get(xs, i - 1)))
analytic("pct_change")(lambda xs, n: F.transform(xs, lambda x, i: F.try_divide(x - F.get(xs, i - 1), F.get(xs, i - 1))))


def cumulative(f):
    """Each step merges twice as many elements: n log n in all."""
    def run(xs, n):
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(xs))
        return F.aggregate(steps, xs, lambda acc, s: F.transform(acc, lambda x, i: f(x, F.get(acc, i - s))))

    return run


analytic("cummax")(cumulative(F.greatest))
analytic("cummin")(cumulative(F.least))


@analytic("zscore")
def zscore(xs, n):
    some = F.filter(xs, lambda v: v.isNotNull())

    def scored(mean):
        sd = F.sqrt(F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, v: s + (v - mean.col) * (v - mean.col)), F.size(some)))
        return held(C(sd, DOUBLE), lambda d: C(F.transform(xs, lambda x: F.when(x.isNotNull(), F.when(d.col == 0, 0.0).otherwise((x - mean.col) / d.col))), T.ArrayType(DOUBLE)))

    return held(C(F.try_divide(total(some), F.size(some)), DOUBLE), scored).col


@array("equi_join")
def equi_join(c, a):
    from .objects import merged
    o, lk, rk = other_keys(a), a.name(1), a.name(2)

    def row(x):
        left = C(x, elem(c))
        hits = F.filter(o.col, lambda y: display(C(y, elem(o)).field(rk)) == display(left.field(lk)))
        return F.transform(hits, lambda y: whole(merged(left, C(y, elem(o)))))

    t = merged(C(None, elem(c)), C(None, elem(o)), shape=True)
    return C(F.flatten(F.transform(c.col, row)), T.ArrayType(t))


@array("pivot")
def pivot(c, a):
    k, v = a.name(0), a.name(a.count - 1)
    f = lambda x, n: C(x, elem(c)).field(n)
    t = f(F.lit(None), v).t
    if a.count == 2:
        return _last_wins(F.transform(c.col, lambda x: F.struct(display(f(x, k)).alias("key"), f(x, v).col.alias("value"))), t)
    keys = F.transform(c.col, lambda x: display(f(x, k)))

    def row(key):
        rows = rows_of(c, keys, key)
        return _last_wins(F.transform(rows, lambda x: F.struct(display(f(x, a.name(1))).alias("key"), f(x, v).col.alias("value"))), t).col

    names = F.array_distinct(keys)
    return C(F.map_from_arrays(names, F.transform(names, row)), T.MapType(STRING, T.MapType(STRING, t)))


def _last_wins(pairs, t):
    """A map of (key, value) structs in which the last of a key stays."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p.getField("key")))
    return C(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p.getField("key") == k), -1).getField("value"))), T.MapType(STRING, t))


@array("from_pairs")
def from_pairs(c, a):
    e = elem(c)
    if isinstance(e, T.StructType):
        kn = next(n for n in ("key", "k") if n in e.names)
        vn = next(n for n in ("val", "value", "v") if n in e.names)
        pairs = F.transform(c.col, lambda x: F.struct(x.getField(kn).alias("key"), x.getField(vn).alias("value")))
        t = e[vn].dataType
    else:
        pairs = F.transform(c.col, lambda x: F.struct(F.get(x, 0).alias("key"), F.get(x, 1).alias("value")))
        t = e.elementType
        if isinstance(t, T.VariantType):
            pairs = F.transform(pairs, lambda p: F.struct(F.try_variant_get(p.getField("key"), "$", "string").alias("key"), p.getField("value").alias("value")))
    return _last_wins(F.filter(pairs, lambda p: p.getField("key").isNotNull()), t)


@array("explode")
def explode(c, a):
    name = a.name(0)
    t = elem(c)
    inner = t[name].dataType
    out = T.StructType([T.StructField(f.name, inner.elementType if f.name == name else f.dataType) for f in t.fields])

    def row(x):
        return F.transform(F.coalesce(x.getField(name), F.array(F.lit(None).cast(inner.elementType))), lambda y: F.struct(*[(y if n == name else x.getField(n)).alias(n) for n in t.names]))

    return C(F.flatten(F.transform(c.col, row)), T.ArrayType(out))


@array("implode")
def implode(c, a):
    name = a.name(0)
    t = elem(c)
    rest = [n for n in t.names if n != name]
    keys = F.transform(c.col, lambda x: F.to_json(F.struct(*[x.getField(n).alias(n) for n in rest]), {"ignoreNullFields": "false"}))
    out = T.StructType([*[t[n] for n in rest], T.StructField(name, T.ArrayType(t[name].dataType))])

    def row(k):
        rows = rows_of(c, keys, k)
        return F.struct(*[F.get(rows, 0).getField(n).alias(n) for n in rest], F.transform(rows, lambda x: x.getField(name)).alias(name))

    return C(F.transform(F.array_distinct(keys), row), T.ArrayType(out))


@builtin("collect")
def collect(c, a):
    if kind(c.t) == "array":
        return c
    if kind(c.t) == "null":
        return C(F.array(), T.ArrayType(c.t))
    return C(F.when(whole(c).isNull(), F.array().cast(T.ArrayType(c.t))).otherwise(F.array(whole(c))), T.ArrayType(c.t))


__all__ = ["BUILTINS"]
