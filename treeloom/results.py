"""Results as JSON-like Python values."""

from __future__ import annotations

import json
import math

from pyspark.sql import Row
from pyspark.sql import types as T

from .functions.values import called, dropped
from .plans.evaluate import Doc, Grouped, as_c, from_grouped
from .plans.relation import Rel


def plain(v, t: T.DataType | None = None):
    """A value as JSON has it; of objects, fields that are left out where they
    are null are not there."""
    if isinstance(v, Row):
        fields = t.fields if isinstance(t, T.StructType) else [T.StructField(n, T.NullType()) for n in v.__fields__]
        return {f.name: plain(x, f.dataType) for f, x in zip(fields, v, strict=True) if x is not None or not dropped(f)}
    if isinstance(v, dict):
        return {k: plain(x, t.valueType if isinstance(t, T.MapType) else None) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x, t.elementType if isinstance(t, T.ArrayType) else None) for x in v]
    if isinstance(v, T.VariantVal):
        return json.loads(v.toJson())
    if isinstance(v, float) and not math.isfinite(v):
        return 0
    return v


def rows_of(df) -> list:
    return [plain(r, df.schema) for r in df.collect()]


def ordered(rel: Rel):
    return rel.on(rel.df.orderBy(*rel.sorting())).result() if rel.order else rel.result()


def python_value(engine, text: str):
    value, env = engine.value(text)
    if isinstance(value, Grouped):
        value = from_grouped(value)
    if isinstance(value, Doc):
        out = {n: rows_of(ordered(t)) for n, t in value.tables.items()}
        if value.row is not None:
            out |= rows_of(env.scope.df.select(*[called(c_whole(p), n, p.drop) for n, p in value.row.parts.items()]))[0]
        return out
    if isinstance(value, Rel):
        rows = rows_of(ordered(value))
        if value.names is None:
            rows = [r["value"] for r in rows]
        if value.single:
            return rows[0] if rows else None
        if value.keyed:
            return {r["key"]: r["value"] if set(r) == {"key", "value"} else {k: v for k, v in r.items() if k != "key"} for r in rows}
        return rows
    c = as_c(value, env)
    if c.parts is not None:
        # a part has its own type: Spark's may forget what is left out
        got = env.scope.df.select(*[c_whole(p).alias(f"v{i}") for i, p in enumerate(c.parts.values())]).first()
        return {n: plain(v, p.t) for (n, p), v in zip(c.parts.items(), got, strict=True) if v is not None or not p.drop}
    return plain(env.scope.df.select(c_whole(c).alias("value")).first()[0], c.t)


def c_whole(c):
    from .functions.values import whole
    return whole(c)
