"""SELECT -> Spark SQL with its sources bound as DataFrames; Catalyst does the rest.

Nothing runs here.  Sources are bound by name to ``spark.sql``, so no view stays behind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..dialect import ast as A
from ..errors import SqlError
from ..functions import types
from ..functions.scalar import call

#: Gives the DataFrame of a table, view or system table by name; raises SqlError.
Resolver = Callable[[str], DataFrame]


def braced(text: str) -> str:
    """Braces doubled, as text with bound sources is a format string."""
    return text.replace("{", "{{").replace("}", "}}")


def quoted(name: str) -> str:
    return "`" + braced(name.replace("`", "``")) + "`"


def literal(value) -> tuple[str, str]:
    if value is None:
        return "NULL", "NULL"
    if isinstance(value, bool):
        return str(value).upper(), "BIT"
    if isinstance(value, int):
        return str(value), "INT"
    if isinstance(value, float):
        return f"{value!r}D", "FLOAT"
    return "'" + braced(value.replace("\\", "\\\\").replace("'", "\\'")) + "'", "VARCHAR"


@dataclass
class Active:
    """A source in scope: the names it goes by, its SQL alias and columns by lower-case name."""

    names: set[str]
    alias: str
    schema: T.StructType


@dataclass
class Scope:
    sources: list[Active] = field(default_factory=list)
    outer: Scope | None = None

    def find(self, column: A.Column) -> tuple[str, T.DataType]:
        scope: Scope | None = self
        while scope is not None:
            for s in scope.sources:
                if column.table is None or column.table.lower() in s.names:
                    for f in s.schema.fields:
                        if f.name.lower() == column.name.lower():
                            return f"{s.alias}.{quoted(f.name)}", f.dataType
                    if column.table is not None:
                        raise SqlError("name", f"{column.table} has no column {column.name}")
            scope = scope.outer
        raise SqlError("name", f"there is no {'table ' + column.table if column.table else 'column ' + column.name} here")


class Compiler:
    def __init__(self, spark: SparkSession, resolve: Resolver, now: int | None = None):
        """``now``: GETDATE() in microseconds, one instant for all of a statement."""
        self.spark, self.resolve, self.now = spark, resolve, now
        self.bound: dict[str, DataFrame] = {}

    def run(self, query: A.Select) -> DataFrame:
        return self.sql(self.select(query, None))

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text if self.bound else text.replace("{{", "{").replace("}}", "}"), **self.bound)

    def bind(self, df: DataFrame) -> str:
        name = f"s{len(self.bound)}"
        self.bound[name] = df
        return name

    def source(self, s: A.Source, scope: Scope, df: DataFrame | None = None) -> str:
        df = self.resolve(s.name) if df is None else df
        name = self.bind(df)
        active = Active({(s.alias or s.name).lower(), *([] if s.alias else [s.name.rpartition(".")[2].lower()]), s.name.lower()}, f"t{name}", df.schema)
        scope.sources.append(active)
        return f"{{{name}}} AS {active.alias}"

    def select(self, q: A.Select, outer: Scope | None, exists: bool = False) -> str:
        scope = Scope(outer=outer)
        text = ""
        if q.source:
            text = " FROM " + self.source(q.source, scope)
            for j in q.joins:
                text += f" {j.kind} JOIN {self.source(j.source, scope)}"
                if j.on is not None:
                    text += f" ON {self.expr(j.on, scope)[0]}"
        if q.where is not None:
            if A.has_aggregate(q.where):
                raise SqlError("unsupported", "WHERE cannot hold an aggregate")
            text += f" WHERE {self.expr(q.where, scope)[0]}"
        grouped = bool(q.group) or any(A.has_aggregate(i.expr) for i in q.items)
        if q.group:
            text += " GROUP BY " + ", ".join(self.expr(g, scope)[0] for g in q.group)
        if q.having is not None:
            text += f" HAVING {self.expr(q.having, scope)[0]}"
        items, names = [], []
        for i in q.items:
            if isinstance(i.expr, A.Star):
                chosen = [s for s in scope.sources if i.expr.table is None or i.expr.table.lower() in s.names]
                if not chosen:
                    raise SqlError("name", f"there is no table {i.expr.table} here")
                for s in chosen:
                    items += [f"{s.alias}.{quoted(f.name)} AS {quoted(f.name)}" for f in s.schema.fields]
                    names += [f.name for f in s.schema.fields]
                continue
            name = i.alias or (i.expr.name if isinstance(i.expr, A.Column) else str(i.expr) if grouped else "result" if not q.source else str(i.expr))
            items.append(f"{self.expr(i.expr, scope)[0]} AS {quoted(name)}")
            names.append(name)
        if exists:
            return f"SELECT {', '.join(items) if grouped else '1'}{text}"
        if q.order:
            known = {n.lower(): n for n in names}
            keys = []
            for e, down in q.order:
                sql = quoted(known[e.name.lower()]) if isinstance(e, A.Column) and e.table is None and names.count(known.get(e.name.lower(), "")) == 1 else self.expr(e, scope)[0]
                keys.append(sql + (" DESC" if down else " ASC"))
            text += " ORDER BY " + ", ".join(keys)
        if q.top is not None:
            text += f" LIMIT {q.top}"
        return f"SELECT {', '.join(items)}{text}"

    # expressions: (Spark SQL, dialect type)
    def expr(self, e, scope: Scope) -> tuple[str, str]:
        if isinstance(e, A.Literal):
            return literal(e.value)
        if isinstance(e, A.Column):
            sql, kind = scope.find(e)
            return sql, types.of(kind)
        if isinstance(e, A.Call):
            if e.args == (A.Star(),):
                if e.name.upper() != "COUNT":
                    raise SqlError("arity", f"{e.name} does not take *")
                return "count(1)", "INT"
            got = [self.expr(a, scope) for a in e.args]
            sql, kind = call(e.name, [g[0] for g in got], [g[1] for g in got])
            return (f"timestamp_micros({self.now})" if sql == "current_timestamp()" and self.now else sql), kind
        if isinstance(e, A.Unary):
            sql, kind = self.expr(e.arg, scope)
            return (f"(NOT {sql})", "BIT") if e.op == "NOT" else (f"(- {sql})", kind)
        if isinstance(e, A.IsNull):
            return f"({self.expr(e.arg, scope)[0]} IS {'NOT ' * e.negated}NULL)", "BIT"
        if isinstance(e, A.Binary):
            return self.binary(e, scope)
        if isinstance(e, A.Between):
            both = A.Binary("AND", A.Binary(">=", e.arg, e.low), A.Binary("<=", e.arg, e.high))
            return self.binary(both, scope)
        if isinstance(e, A.InList):
            left = self.expr(e.arg, scope)
            pairs = [self.alike(left, self.expr(x, scope)) for x in e.items]
            if len({p[0] for p in pairs}) == 1:
                return f"({pairs[0][0]} IN ({', '.join(p[1] for p in pairs)}))", "BIT"
            return "(" + " OR ".join(f"{a} = {b}" for a, b in pairs) + ")", "BIT"
        if isinstance(e, A.InQuery):
            sub = self.named(e.query, scope)
            return f"({self.expr(e.arg, scope)[0]} IN (SELECT k FROM ({sub}) AS q(k) WHERE k IS NOT NULL))", "BIT"
        if isinstance(e, A.Exists):
            return f"(EXISTS ({self.select(e.query, scope, exists=True)}))", "BIT"
        if isinstance(e, A.Scalar):
            return self.scalar(e.query, scope)
        if isinstance(e, A.Star):
            raise SqlError("syntax", "* stands alone in a select list or in COUNT(*)")
        raise SqlError("unsupported", f"cannot compile {e}")

    def named(self, q: A.Select, scope: Scope) -> str:
        """A subquery of one column, the first where there are more."""
        sql = self.select(q, scope)
        first = q.items[0].expr
        if len(q.items) > 1 or isinstance(first, A.Star):
            width = len(self.sql(sql).columns)  # analysed only
            return f"SELECT c0 FROM ({sql}) AS w({', '.join(f'c{i}' for i in range(width))})"
        return sql

    def scalar(self, q: A.Select, scope: Scope) -> tuple[str, str]:
        inner = Compiler(self.spark, self.resolve)
        kind = ""
        try:
            kind = types.of(inner.run(q).schema.fields[0].dataType)
        except SqlError:  # it refers to the outer query
            pass
        if not q.group and q.items and all(A.has_aggregate(i.expr) for i in q.items) and len(q.items) == 1:
            return f"({self.select(q, scope)})", kind
        sql = self.named(q, scope)
        return f"(SELECT first(k) FROM (SELECT * FROM ({sql}) LIMIT 1) AS q(k))", kind

    def alike(self, a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
        """Both sides of a comparison, converted where the dialect allows what ANSI mode does not."""
        (x, kx), (y, ky) = a, b
        for this, other in ((kx, ky), (ky, kx)):
            if this == "BIT" and other in ("INT", "FLOAT"):
                return (f"CAST({x} AS INT)", y) if kx == "BIT" else (x, f"CAST({y} AS INT)")
            if this == "DATETIME" and other == "VARCHAR":
                return (x, f"CAST({y} AS TIMESTAMP)") if kx == "DATETIME" else (f"CAST({x} AS TIMESTAMP)", y)
            if this == "DATETIME" and other == "INT":
                return (x, f"timestamp_millis({y})") if kx == "DATETIME" else (f"timestamp_millis({x})", y)
            if this == "BIT" and other == "VARCHAR":
                return (x, types.convert(y, "VARCHAR", "BIT")) if kx == "BIT" else (types.convert(x, "VARCHAR", "BIT"), y)
        return x, y

    def binary(self, e: A.Binary, scope: Scope) -> tuple[str, str]:
        a, b = self.expr(e.left, scope), self.expr(e.right, scope)
        if e.op in ("AND", "OR", "LIKE"):
            return f"({a[0]} {e.op} {b[0]})", "BIT"
        if e.op in ("=", "<>", "<", ">", "<=", ">="):
            x, y = self.alike(a, b)
            return f"({x} {e.op} {y})", "BIT"
        if e.op == "+" and "VARCHAR" in (a[1], b[1]) and {a[1], b[1]} <= {"VARCHAR", "NULL", ""}:
            return f"concat({a[0]}, {b[0]})", "VARCHAR"
        kind = "FLOAT" if e.op == "/" or "FLOAT" in (a[1], b[1]) else a[1] if a[1] != "NULL" else b[1]
        return f"({a[0]} {e.op} {b[0]})", kind
