"""Numeric, conversion and type builtins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import BOOL, DOUBLE, LONG, NULL, STRING, C, QueryError, builtin, cast, display, is_int, json_text, kind, lit, numeric, whole


def rounding(name, f):
    @builtin(name)
    def run(c, a):
        if kind(c.t) == "variant":
            c = numeric(c)
        if kind(c.t) == "null":
            return c
        if kind(c.t) != "number":
            raise QueryError(f"{name} needs a number, not {kind(c.t)}")
        return c if is_int(c.t) else C(f(c.col.cast("double")).cast("bigint"), LONG)


rounding("ceil", F.ceil)
rounding("floor", F.floor)
rounding("round", lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))


@builtin("abs")
def abs_(c, a):
    if kind(c.t) not in ("number", "null"):
        raise QueryError(f"abs needs a number, not {kind(c.t)}")
    return c if kind(c.t) == "null" else C(F.abs(c.col), c.t)


@builtin("to_string")
def to_string(c, a):
    return C(display(c), STRING)


@builtin("to_json")
def to_json(c, a):
    return C(F.coalesce(json_text(c), F.lit("null")) if kind(c.t) != "null" else F.lit("null"), STRING)


@builtin("type")
def type_(c, a):
    k = kind(c.t)
    if k == "null":
        return lit("null")
    if k == "variant":
        s = F.schema_of_variant(c.col)
        name = (F.when(c.col.isNull() | s.isin("VOID"), "null").when(s == "BOOLEAN", "bool").when(s == "STRING", "string")
                .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number"))
        return C(name, STRING)
    if c.parts is not None:
        return lit("object")
    return C(F.when(whole(c).isNull(), "null").otherwise("string" if k == "other" else k), STRING)


def kind_test(c: C, name: str) -> C:
    if kind(c.t) == "variant":
        return C(type_(c, None).col == name, BOOL)
    if name == "null":
        return lit(True) if kind(c.t) == "null" else lit(False) if c.parts is not None else C(whole(c).isNull(), BOOL)
    if ("string" if kind(c.t) == "other" else kind(c.t)) != name:
        return lit(False)
    return lit(True) if c.parts is not None else C(whole(c).isNotNull(), BOOL)


def convert(c: C, to: str, trying: bool) -> C:
    """``c as to``: null is 0, text that is no number fails or, in a try, is
    null; number means float."""
    k, x = kind(c.t), whole(c)
    if k == "variant" and to in ("int", "float", "number", "string", "bool"):
        if to == "string":
            return C(display(c), STRING)
        spark_t = {"int": "bigint", "float": "double", "number": "double", "bool": "boolean"}[to]
        return C((F.try_variant_get if trying else F.variant_get)(c.col, "$", spark_t), T._parse_datatype_string(spark_t))
    if to in ("int", "float", "number"):
        t = LONG if to == "int" else DOUBLE
        if k == "null":
            return lit(0) if to == "int" else lit(0.0)
        if k in ("array", "object"):
            raise QueryError(f"no cast of {k} to {to}")
        if k == "number":
            got = (F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)) if to == "int" and not is_int(c.t) else x).cast(t)
        elif k == "string":
            s = F.trim(x)
            got = s.try_cast("double") if trying else s.cast("double")
            got = F.coalesce(s.try_cast("bigint"), got.cast(t)) if to == "int" else got
        else:
            got = x.cast(t)
        return C(got if trying and k == "string" else F.when(x.isNull(), F.lit(0).cast(t)).otherwise(got), t)
    if to == "string":
        return C(display(c), STRING)
    if to == "bool":
        from .values import truthy
        return C(truthy(c), BOOL)
    if to == "null":
        return NULL
    if to == "array":
        return c if k == "array" else C(F.when(x.isNull(), F.array()).otherwise(F.array(x)) if k != "null" else F.array(), T.ArrayType(c.t))
    if k == "object":
        return c
    raise QueryError(f"no cast of {k} to object")


def csv_cell(c: C, sep: str):
    text = F.when(whole(c).isNull(), "").otherwise(display(c)) if kind(c.t) != "null" else F.lit("")
    if kind(c.t) != "string":
        return text
    quoted = F.concat(F.lit('"'), F.replace(c.col, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.contains(c.col, F.lit(sep)) | F.contains(c.col, F.lit('"')) | F.contains(c.col, F.lit("\n")), quoted).otherwise(text)


def csv_row(c: C, sep: str):
    if isinstance(c.t, T.StructType):
        return F.concat_ws(sep, *[csv_cell(c.field(n), sep) for n in c.t.names])
    if isinstance(c.t, T.ArrayType):
        return F.array_join(F.transform(whole(c), lambda x: csv_cell(C(x, c.t.elementType), sep)), sep)
    return csv_cell(c, sep)


def _csv(sep):
    def run(c, a):
        if isinstance(c.t, T.ArrayType) and isinstance(c.t.elementType, (T.StructType, T.ArrayType)):
            return C(F.array_join(F.transform(whole(c), lambda x: csv_row(C(x, c.t.elementType), sep)), "\n"), STRING)
        return C(csv_row(c, sep), STRING)

    return run


builtin("to_csv")(_csv(","))
builtin("to_tsv")(_csv("\t"))

#: What schema() calls the kinds.
SCHEMA_NAMES = {"null": "Null", "bool": "Bool", "string": "String", "array": "Array", "object": "Object", "variant": "Unknown", "other": "String"}


def describe(t: T.DataType) -> str:
    """schema() of a static type, as JSON."""
    import json

    def of(t):
        k = kind(t)
        if k == "number":
            return {"type": "Int" if is_int(t) else "Float"}
        if isinstance(t, T.ArrayType):
            return {"type": "Array", "items": of(t.elementType)}
        if isinstance(t, T.StructType):
            return {"type": "Object", "required": [f.name for f in t.fields], "fields": {f.name: of(f.dataType) for f in t.fields}}
        return {"type": SCHEMA_NAMES[k]}

    return json.dumps(of(t), separators=(",", ":"))


@builtin("schema")
def schema(c, a):
    return lit(describe(c.t)) if kind(c.t) != "variant" else C(F.schema_of_variant(c.col), STRING)


@builtin("or")
def or_(c, a):
    return coalesce([c, a.val(0)])


def coalesce(items: list[C]) -> C:
    from .values import common
    items = [c for c in items if kind(c.t) != "null"]
    if not items:
        return NULL
    t = common([c.t for c in items])
    return C(F.coalesce(*[cast(c, t).col for c in items]), t)


@builtin("set")
def set_(c, a):
    return a.val(0)


@builtin("update", "modify")
def update(c, a):
    return a.fn(0)(c)
