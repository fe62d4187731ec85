"""Relations: DataFrames whose rows are the elements of an array."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import C, QueryError, called, display, dropped, struct_of, whole

VALUE = "value"
_ids = itertools.count()


def fresh(tag: str) -> str:
    return f"__{tag}{next(_ids)}"


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def falling(x: Column, t: T.DataType) -> Column:
    """A value that falls where ``x`` rises; only for values that are not null.

    Whole numbers are complemented, which does not overflow; NaN is the
    largest number; the bytes of a text are turned round and closed by a
    letter above them all, so that a text comes before its beginnings.
    """
    if isinstance(t, T.BooleanType):
        return ~x
    if isinstance(t, T.IntegralType):
        return F.bitwise_not(x)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.struct((~F.isnan(x)).alias("n"), (-x).alias("x"))
    if isinstance(t, T.DecimalType):
        return -x
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.bitwise_not(F.unix_micros(x.cast("timestamp")))
    if isinstance(t, T.DateType):
        return F.bitwise_not(F.unix_date(x))
    if isinstance(t, (T.StringType, T.BinaryType)):
        digits = F.hex(F.encode(x, "UTF-8") if isinstance(t, T.StringType) else x)
        return F.concat(F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    if isinstance(t, T.StructType):
        return F.struct(*[f(x.getField(c.name), c.dataType).alias(f"{k}{i}") for i, c in enumerate(t.fields) for k, f in (("n", lambda v, _: v.isNull()), ("v", falling))])
    if isinstance(t, T.ArrayType):
        part = lambda v: F.struct(F.lit(False).alias("e"), v.isNull().alias("n"), falling(v, t.elementType).alias("v"))
        items = F.transform(x, part)
        return F.concat(items, F.transform(F.array(F.lit(0)), lambda _: F.struct(F.lit(True).alias("e"), F.lit(True).alias("n"), falling(F.lit(None).cast(t.elementType), t.elementType).alias("v"))))
    raise QueryError(f"{t.simpleString()} has no order")


@dataclass
class Rel:
    """``names`` are the visible columns; a relation of scalars has none and
    its column is ``value``. ``order`` lists (hidden column, descending);
    ``single`` marks at most one row, ``keyed`` an object with the keys in the
    column ``key``."""

    df: DataFrame
    names: list[str] | None
    order: list[tuple[str, bool]] = field(default_factory=list)
    single: bool = False
    keyed: bool = False

    @property
    def elem(self) -> C:
        schema = self.df.schema
        if self.names is None:
            return C(column(VALUE), schema[VALUE].dataType)
        return struct_of({n: C(column(n), schema[n].dataType, drop=dropped(schema[n])) for n in self.names})

    def columns(self) -> list[str]:
        return [VALUE] if self.names is None else list(self.names)

    def hidden(self) -> list[Column]:
        return [column(n) for n, _ in self.order]

    def sorting(self, back: bool = False) -> list[Column]:
        """Columns to sort by; nulls come first, or last when descending."""
        if not self.order:
            raise QueryError("this needs an order: register the table with one, or sort")
        return [column(n).desc() if down != back else column(n).asc() for n, down in self.order]

    def place(self, back: bool = False) -> Column:
        """One value that rises along the order, for min_by and the like. As in
        ``sorting``, nulls come first, or last when descending."""
        parts = []
        schema = self.df.schema
        for n, down in self.order or self.sorting():
            x = column(n)
            if down != back:
                parts += [x.isNull().alias(f"o{len(parts)}"), falling(x, schema[n].dataType).alias(f"o{len(parts) + 1}")]
            else:
                parts.append(x.alias(f"o{len(parts)}"))
        return F.struct(*parts)

    def select(self, c: C, df: DataFrame | None = None, **more) -> Rel:
        """The relation of what an expression makes of each row."""
        df = self.df if df is None else df
        if isinstance(c.t, T.StructType):
            names = list(c.t.names)
            cols = [called(whole(c.field(n)), n, c.field(n).drop) for n in names]
        else:
            names, cols = None, [whole(c).alias(VALUE)]
        if isinstance(c.t, T.NullType):
            cols = [F.lit(None).cast("string").alias(VALUE)]
        return replace(self, df=df.select(*cols, *self.hidden()), names=names, **more)

    def on(self, df: DataFrame, **more) -> Rel:
        return replace(self, df=df, **more)

    def result(self) -> DataFrame:
        """The visible columns, in order where there is one."""
        return self.df.select(*[column(n) for n in self.columns()])


class Scope:
    """Rows an expression is evaluated on. Single values and lookups that it
    mentions are joined to them, so that it stays one Column. Lookups of one
    table by one key become one aggregate and one join."""

    def __init__(self, df: DataFrame):
        self.rows = df
        self.asked: dict[tuple, list] = {}

    @property
    def df(self) -> DataFrame:
        asked, self.asked = self.asked, {}
        for table, key, outer, aggs in asked.values():
            name = fresh("k")
            found = table.groupBy(key.alias(name)).agg(*aggs)
            self.rows = self.rows.join(found, column(name).eqNullSafe(outer), "left").drop(name)
        return self.rows

    @df.setter
    def df(self, df: DataFrame):
        self.asked, self.rows = {}, df

    def single(self, rel: Rel) -> C:
        name = fresh("s")
        got = rel.df.select(whole(rel.elem).alias(name))
        t = got.schema[name].dataType
        # at most one row: the side to send is bounded by that
        self.df = self.df.join(F.broadcast(got), F.lit(True), "left")
        return C(column(name), t)

    def lookup(self, table: DataFrame, key: Column, name: str, t: T.DataType) -> C:
        """Left join with a table of (key column ``<name>k``, value ``name``)
        with one row for each key; Catalyst picks the join by its size."""
        self.df = self.df.join(table, column(name + "k").eqNullSafe(key), "left").drop(name + "k")
        return C(column(name), t)

    def aggregate(self, table: DataFrame, key: Column, outer: Column, agg: Column, t: T.DataType) -> C:
        """A lookup of an aggregate of a table's rows by a key."""
        name = fresh("c")
        at = (id(table), str(key), str(outer))
        self.asked.setdefault(at, (table, key, outer, []))[3].append(agg.alias(name))
        return C(column(name), t)


def gathered(rel: Rel, cond: Column | None = None, elem: C | None = None) -> C:
    """An aggregate: the elements as an array, in order where there is one."""
    e = rel.elem if elem is None else elem
    item = whole(e)
    if rel.order:
        pair = F.struct(rel.place().alias("p"), item.alias("v"))
        got = F.transform(F.array_sort(F.collect_list(pair if cond is None else F.when(cond, pair))), lambda x: x.getField("v"))
    else:
        got = F.collect_list(F.struct(item.alias("v")) if cond is None else F.when(cond, F.struct(item.alias("v"))))
        got = F.transform(got, lambda x: x.getField("v"))
    return C(got, T.ArrayType(e.t))


def key_text(c: C) -> Column:
    return display(c)
