"""Syntax tree; ``str`` of an expression is the text that names an unaliased aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object

    def __str__(self):
        v = self.value
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


@dataclass(frozen=True)
class Column:
    name: str
    table: str | None = None

    def __str__(self):
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Star:
    table: str | None = None

    def __str__(self):
        return f"{self.table}.*" if self.table else "*"


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Unary:
    op: str  # - NOT
    arg: object

    def __str__(self):
        return f"(NOT {self.arg})" if self.op == "NOT" else f"(-{self.arg})"


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool

    def __str__(self):
        return f"({self.arg} IS {'NOT ' * self.negated}NULL)"


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object

    def __str__(self):
        return f"({self.arg} BETWEEN {self.low} AND {self.high})"


@dataclass(frozen=True)
class InList:
    arg: object
    items: tuple

    def __str__(self):
        return f"({self.arg} IN ({', '.join(map(str, self.items))}))"


@dataclass(frozen=True)
class InQuery:
    arg: object
    query: Select

    def __str__(self):
        return f"({self.arg} IN (subquery))"


@dataclass(frozen=True)
class Exists:
    query: Select

    def __str__(self):
        return "EXISTS(subquery)"


@dataclass(frozen=True)
class Scalar:
    query: Select

    def __str__(self):
        return "(subquery)"


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # INNER LEFT CROSS
    source: Source
    on: object = None


@dataclass(frozen=True)
class Select:
    items: tuple
    source: Source | None = None
    joins: tuple = ()
    where: object = None
    group: tuple = ()
    having: object = None
    order: tuple = ()  # (expr, descending)
    top: int | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    primary: bool = False
    unique: bool = False
    check: str | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple


@dataclass(frozen=True)
class CreateView:
    name: str
    sql: str


@dataclass(frozen=True)
class CreateTrigger:
    name: str
    table: str
    timing: str  # AFTER, INSTEAD OF
    event: str
    sql: str


@dataclass(frozen=True)
class Drop:
    what: str  # TABLE VIEW TRIGGER
    name: str


@dataclass(frozen=True)
class AlterAdd:
    table: str
    column: ColumnDef


@dataclass(frozen=True)
class AlterDrop:
    table: str
    column: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple | None
    rows: tuple = ()
    query: Select | None = None


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple
    where: object = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class Transaction:
    what: str  # BEGIN COMMIT ROLLBACK


AGGREGATES = frozenset(("COUNT", "SUM", "AVG", "MIN", "MAX"))


def parts(e) -> list:
    """Direct subexpressions, not going into subqueries."""
    if isinstance(e, Call):
        return list(e.args)
    if isinstance(e, Binary):
        return [e.left, e.right]
    if isinstance(e, Between):
        return [e.arg, e.low, e.high]
    if isinstance(e, InList):
        return [e.arg, *e.items]
    if isinstance(e, (Unary, IsNull, InQuery)):
        return [e.arg]
    return []


def has_aggregate(e) -> bool:
    return isinstance(e, Call) and e.name.upper() in AGGREGATES or any(map(has_aggregate, parts(e)))


__all__ = [n for n in dir() if not n.startswith("_")] + ["field"]
