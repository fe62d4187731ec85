"""The engine: tables by name, queries by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import C, QueryError, struct_of, whole
from .lang.parser import ParseError, parse
from .plans.evaluate import Doc, Env, Grouped, as_c, evaluate, from_grouped
from .plans.relation import Rel, Scope, column

__all__ = ["Engine", "ParseError", "QueryError"]


class Engine:
    """Queries over a document: ``$.name`` is a registered table, or a field of
    the document row. Nothing runs until the result's rows are asked for, but
    for the quantiles that cut a table into ranges where positions are needed."""

    PLANS = 256

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Rel] = {}
        self.row: DataFrame | None = None
        self.parsed: dict[str, object] = {}

    def table(self, name: str, df: DataFrame, order: list[str] | None = None) -> Engine:
        """Register a table. ``order`` names the columns that put its rows in
        order, ``-name`` in descending order; a one-column table named
        ``value`` is an array of scalars."""
        hidden, cols = [], []
        for i, o in enumerate(order or []):
            n = f"__n{i}"
            cols.append(column(o.lstrip("-")).alias(n))
            hidden.append((n, o.startswith("-")))
        names = None if df.columns == ["value"] else df.columns
        self.tables[name] = Rel(df.select("*", *cols), names, hidden)
        return self

    def document(self, df: DataFrame) -> Engine:
        """Make a one-row DataFrame the document; its columns are its fields."""
        self.row = df
        return self

    def parse(self, text: str):
        if text not in self.parsed:
            if len(self.parsed) >= self.PLANS:
                self.parsed.clear()
            self.parsed[text] = parse(text)
        return self.parsed[text]

    def value(self, text: str):
        base = self.row if self.row is not None else self.spark.range(1).select(F.lit(0).alias("__one"))
        scope = Scope(base)
        row = None if self.row is None else struct_of({f.name: C(column(f.name), f.dataType) for f in base.schema.fields})
        doc = Doc(self.tables, row)
        env = Env({}, doc, scope, doc)
        return evaluate(self.parse(text), env), env

    def query(self, text: str) -> DataFrame:
        """The result of a query: a row for each element of an array, key and
        value columns for an object with keys from the data, or one row. A
        write gives the table it wrote to."""
        value, env = self.value(text)
        if isinstance(value, Grouped):
            value = from_grouped(value)
        if isinstance(value, Doc):
            changed = getattr(value, "changed", [])
            if len(changed) == 1:
                value = value.tables[changed[0]]
            elif value.row is not None and not changed:
                value = value.row
            else:
                raise QueryError("several tables were written: use queries()")
        if isinstance(value, Rel):
            return value.result()
        c = as_c(value, env)
        if c.parts is not None:
            return env.scope.df.select(*[whole(p).alias(n) for n, p in c.parts.items()])
        return env.scope.df.select(whole(c).alias("value"))

    def queries(self, text: str) -> dict[str, DataFrame]:
        """All tables of the document that a write gives."""
        value, _ = self.value(text)
        if not isinstance(value, Doc):
            raise QueryError("not a document")
        return {n: r.result() for n, r in value.tables.items()}

    def collect(self, text: str):
        """The result as Python values, for small results: a list for an array,
        a dict for an object, or a scalar."""
        from .results import python_value
        return python_value(self, text)
