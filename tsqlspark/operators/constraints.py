"""Column constraints, checked by distributed aggregates before a write is published.

Rows that were there already satisfy what concerns one row, so NOT NULL and CHECK look at
new rows only.  UNIQUE looks for keys that are twice among the new rows, or also stand in
rows that stay: a semi join with the new keys, not an aggregation of the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dialect.ast import ColumnDef
from ..errors import SqlError


def check_rows(table: str, columns: list[ColumnDef], new: DataFrame, checks: dict[str, str]) -> None:
    """checks: Spark SQL of each column's CHECK, over the columns of ``new``."""
    tests = [(c.name, "not_null", F.col(f"`{c.name}`").isNull()) for c in columns if not c.nullable]
    tests += [(name, "check", ~F.expr(sql)) for name, sql in checks.items()]
    if not tests:
        return
    found = new.agg(*[F.count(F.when(t, 1)).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)]).first()
    for i, (name, kind, _) in enumerate(tests):
        if found[i]:
            say = "cannot be NULL" if kind == "not_null" else "violates its CHECK constraint"
            raise SqlError(kind, f"column {name} of {table} {say}")


def check_unique(table: str, columns: list[ColumnDef], new: DataFrame, stay: DataFrame | None) -> None:
    for c in (c for c in columns if c.unique):
        keys = new.select(F.col(f"`{c.name}`").alias("k")).filter("k IS NOT NULL")
        twice = keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
        if stay is not None:
            twice = twice.union(stay.select(F.col(f"`{c.name}`").alias("k")).join(keys, "k", "left_semi"))
        if not twice.limit(1).isEmpty():
            say = "PRIMARY KEY" if c.primary else "UNIQUE"
            raise SqlError("unique", f"column {c.name} of {table} has a value twice against its {say} constraint")
