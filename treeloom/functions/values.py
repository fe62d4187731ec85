"""Typed Column expressions and the rules of values.

``C`` is a Column with its Spark type. The rules: null, false, 0, "", [] and {}
are falsy; values of different kinds are unequal, never null; comparisons of
kinds that have no order are false; keys are compared by their display text.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QueryError(ValueError):
    """A query that cannot be planned; raised before anything runs."""


@dataclass
class C:
    col: Column
    t: T.DataType
    #: a literal's value, so that counts and names are known when planning
    lit: object = ...
    #: fields of a row or an object, to reach them without building a struct
    parts: dict | None = None
    #: a test that is null or false where this one is false: a filter takes it
    #: instead, so that the scan can have it
    keep: Column | None = None
    #: as a field of an object it is left out where it is null
    drop: bool = False

    def field(self, name: str) -> C:
        if self.parts is not None:
            return self.parts.get(name, NULL)
        if isinstance(self.t, T.StructType):
            return C(self.col.getField(name), self.t[name].dataType, drop=dropped(self.t[name])) if name in self.t.names else NULL
        if isinstance(self.t, T.MapType):
            return C(F.try_element_at(self.col, F.lit(name)), self.t.valueType)
        if isinstance(self.t, T.VariantType):
            return C(F.try_variant_get(self.col, f'$["{name}"]', "variant"), self.t)
        return NULL


DROP = {"drop": True}


def dropped(f: T.StructField) -> bool:
    """Whether a field is left out where it is null."""
    return bool((f.metadata or {}).get("drop"))


def drops(t: T.DataType) -> bool:
    """Whether a type has such a field anywhere."""
    if isinstance(t, T.StructType):
        return any(dropped(f) or drops(f.dataType) for f in t.fields)
    return isinstance(t, T.ArrayType) and drops(t.elementType)


def called(col: Column, name: str, drop: bool) -> Column:
    """A Column under the name of a field."""
    return col.alias(name, metadata=DROP) if drop else col.alias(name)


LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
NULL = C(None, T.NullType(), None)
BUILTINS: dict[str, object] = {}


def null() -> C:
    return C(F.lit(None), T.NullType(), None)


def builtin(*names):
    """Register a builtin: called with the receiver and its arguments."""
    def add(f):
        for n in names:
            BUILTINS[n] = f
        return f

    return add


def lit(value) -> C:
    if value is None:
        return null()
    t = BOOL if isinstance(value, bool) else LONG if isinstance(value, int) else DOUBLE if isinstance(value, float) else STRING
    return C(F.lit(value).cast(t) if t is LONG else F.lit(value), t, value)


def kind(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.VariantType):
        return "variant"
    return "string" if isinstance(t, T.StringType) else "other"


def is_int(t) -> bool:
    return isinstance(t, T.IntegralType)


def whole(c: C) -> Column:
    """The Column of a value; of a row the struct of its fields."""
    if c.col is None:
        if c.parts is not None:
            return F.struct(*[called(whole(p), n, p.drop) for n, p in c.parts.items()]) if c.parts else F.struct()
        return F.lit(None)
    return c.col


def solid(c: C) -> C:
    return C(whole(c), c.t, c.lit)


def truthy(c: C) -> Column:
    if c.lit is not ...:
        return F.lit(bool(c.lit))
    k, x = kind(c.t), whole(c)
    if k == "null":
        return F.lit(False)
    if k == "bool":
        return F.coalesce(x, F.lit(False))
    if k == "number":
        return F.coalesce(x != 0, F.lit(False))
    if k == "string":
        return F.coalesce(F.length(x) > 0, F.lit(False))
    if k == "array":
        return F.coalesce(F.size(x) > 0, F.lit(False))
    if isinstance(c.t, T.MapType):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    if k == "variant":
        text = F.to_json(x)
        return F.coalesce(~text.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))
    return x.isNotNull()


def kept(c: C) -> Column:
    """A test as a filter takes it."""
    return truthy(c) if c.keep is None else c.keep


def scalar(c: C, like: C) -> C:
    """A variant read as the kind of the value it meets."""
    if kind(c.t) == "variant" and kind(like.t) in ("number", "string", "bool"):
        to = {"number": "double", "string": "string", "bool": "boolean"}[kind(like.t)]
        return C(F.try_variant_get(c.col, "$", to), T._parse_datatype_string(to))
    return c


def equal(a: C, b: C) -> Column:
    a, b = scalar(a, b), scalar(b, a)
    ka, kb = kind(a.t), kind(b.t)
    if ka == "null" or kb == "null":
        other = b if ka == "null" else a
        return F.lit(True) if kind(other.t) == "null" else whole(other).isNull()
    if ka != kb:
        return whole(a).isNull() & whole(b).isNull()
    if ka in ("array", "object"):
        return whole(a).isNull() & whole(b).isNull()  # compounds are never equal
    return whole(a).eqNullSafe(whole(b))


def order(op: str, a: C, b: C) -> Column:
    a, b = scalar(a, b), scalar(b, a)
    if kind(a.t) != kind(b.t) or kind(a.t) not in ("number", "string", "bool", "other"):
        return F.lit(False)
    return F.coalesce(bare_order(op, a, b), F.lit(False))


def bare_order(op: str, a: C, b: C) -> Column:
    x, y = whole(a), whole(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def plain_double(x: Column) -> Column:
    """Digits of a double without an exponent; whole ones without a fraction."""
    text = x.cast("string")
    wide = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
            .when((x == 0) & text.startswith("-"), "-0").when((F.abs(x) < 1e18) & (x == F.floor(x)), x.cast("decimal(38,0)").cast("string"))
            .when(text.contains("E") & (F.abs(x) >= 1e18), x.cast("decimal(38,0)").cast("string")).when(text.contains("E"), wide).otherwise(text))


def json_parts(c: C) -> Column:
    """JSON text of an object or array some fields of which are left out where
    they are null."""
    x = whole(c)
    if isinstance(c.t, T.ArrayType):
        items = F.transform(x, lambda v: F.coalesce(json_text(C(v, c.t.elementType)), F.lit("null")))
        return F.when(x.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    parts = []
    for f in c.t.fields:
        v = c.field(f.name)
        said = F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), F.coalesce(json_text(v), F.lit("null")))
        parts.append(F.when(whole(v).isNotNull(), said) if dropped(f) else said)
    said = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return said if c.parts is not None else F.when(x.isNotNull(), said)


def json_text(c: C) -> Column:
    if drops(c.t):
        return json_parts(c)
    if kind(c.t) in ("array", "object", "variant"):
        return F.to_json(whole(c), {"ignoreNullFields": "false"})
    if kind(c.t) == "string":
        return F.regexp_replace(F.to_json(F.array(c.col)), r"(?s)^\[(.*)\]$", "$1")
    if isinstance(c.t, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c.col) | (F.abs(c.col) == float("inf")), "null").otherwise(c.col.cast("string"))
    return whole(c).cast("string")


def display(c: C) -> Column:
    """Display text; null shows as ``null``."""
    k = kind(c.t)
    if k == "null":
        return F.lit("null")
    if k in ("array", "object", "variant"):
        text = json_text(c)
        if k == "variant":
            text = F.coalesce(F.when(F.schema_of_variant(c.col) == "STRING", F.try_variant_get(c.col, "$", "string")), text)
    elif isinstance(c.t, (T.DoubleType, T.FloatType)):
        text = plain_double(c.col.cast("double"))
    else:
        text = whole(c).cast("string")
    return F.coalesce(text, F.lit("null"))


def key_string(c: C) -> C:
    return C(display(c), STRING)


def group_key(c: C) -> tuple[Column, bool]:
    """A Column to group by instead of the display text, and whether it is the
    text already: strings and whole numbers stay as they are."""
    if isinstance(c.t, T.StringType):
        return F.coalesce(c.col, F.lit("null")), True
    if is_int(c.t) or isinstance(c.t, T.BooleanType):
        return c.col, False
    return display(c), True


def common(types: list[T.DataType]) -> T.DataType:
    """The type that holds all: numbers widen, nulls fit anything, values of
    different kinds become text-preserving variants."""
    types = [t for t in types if not isinstance(t, T.NullType)]
    if not types:
        return T.NullType()
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return LONG
    if all(isinstance(t, T.NumericType) for t in types):
        return DOUBLE
    if all(isinstance(t, T.ArrayType) for t in types):
        return T.ArrayType(common([t.elementType for t in types]))
    if all(isinstance(t, T.StructType) for t in types):
        names = list(dict.fromkeys(n for t in types for n in t.names))
        # a field that one of them lacks is left out there
        gone = lambda n: any(n not in t.names or dropped(t[n]) for t in types)
        return T.StructType([T.StructField(n, common([t[n].dataType for t in types if n in t.names]), metadata=DROP if gone(n) else None) for n in names])
    return T.VariantType()


def cast(c: C, t: T.DataType) -> C:
    if c.t == t:
        return solid(c)
    if isinstance(t, T.VariantType):
        if kind(c.t) == "null":
            return C(F.lit(None).cast(t), t)
        if kind(c.t) == "other":
            return C(F.parse_json(json_text(C(c.col.cast("string"), STRING))), t)
        text = F.parse_json(json_text(c))
        return C(text if c.parts is not None else F.when(whole(c).isNotNull(), text), t)
    if isinstance(t, T.StructType) and isinstance(c.t, T.StructType) and c.t.names != t.names:
        parts = [called(cast(c.field(f.name), f.dataType).col, f.name, dropped(f)) for f in t.fields]
        built = F.struct(*parts)
        return C(built if c.parts is not None else F.when(whole(c).isNotNull(), built), t)
    if isinstance(t, T.ArrayType) and isinstance(c.t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.VariantType)):
        return C(F.transform(whole(c), lambda x: cast(C(x, c.t.elementType), t.elementType).col), t)
    return C(whole(c).cast(t), t)


def array_of(items: list[C]) -> C:
    t = common([c.t for c in items])
    if not items or isinstance(t, T.NullType):
        return C(F.array(*[F.lit(None) for _ in items]), T.ArrayType(t))
    return C(F.array(*[cast(c, t).col for c in items]), T.ArrayType(t))


def struct_of(fields: dict[str, C]) -> C:
    """An object of known fields; its parts stay reachable."""
    t = T.StructType([T.StructField(n, c.t, metadata=DROP if c.drop else None) for n, c in fields.items()])
    return C(None, t, ..., dict(fields))


def hof(f, c: C, fn, *more):
    """A higher-order function over an array with a typed lambda: the Column,
    and the type the lambda gave."""
    seen = []

    def run(x):
        got = fn(C(x, c.t.elementType))
        got = got if isinstance(got, C) else C(got, BOOL)
        seen.append(got.t)
        return whole(got)

    col = f(whole(c), run, *more)
    return col, seen[0]


def numeric(c: C) -> C:
    """Doubles of the numbers; null for all else."""
    if kind(c.t) == "variant":
        return C(F.try_variant_get(c.col, "$", "double"), DOUBLE)
    if kind(c.t) == "number":
        return C(whole(c).cast("double"), DOUBLE)
    return C(F.lit(None).cast("double"), DOUBLE)
