"""The five types, how Spark types map to them, and write-time conversion."""

from __future__ import annotations

from pyspark.sql import types as T

SPARK = {"INT": T.IntegerType(), "FLOAT": T.DoubleType(), "VARCHAR": T.StringType(), "BIT": T.BooleanType(), "DATETIME": T.TimestampType()}
NAMES = {"INT": "INT", "FLOAT": "DOUBLE", "VARCHAR": "STRING", "BIT": "BOOLEAN", "DATETIME": "TIMESTAMP"}


def of(kind: T.DataType) -> str:
    """Dialect type of a Spark type; '' where there is none (it can only be passed through)."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "VARCHAR"
    if isinstance(kind, T.BooleanType):
        return "BIT"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "DATETIME"
    return "NULL" if isinstance(kind, T.NullType) else ""


def convert(sql: str, have: str, want: str) -> str:
    """Spark SQL that converts an expression of type ``have`` to a column of type ``want``."""
    if want == "INT" and have == "FLOAT":
        return f"CAST(bround({sql}) AS INT)"  # halves go to the even neighbour
    if want == "BIT" and have == "VARCHAR":
        return f"(lower({sql}) IN ('true', '1'))"
    if want == "BIT" and have in ("INT", "FLOAT"):
        return f"({sql} <> 0)"
    if want == "DATETIME" and have == "INT":
        return f"timestamp_millis({sql})"
    if want == "DATETIME" and have != "NULL":
        return f"date_trunc('MILLISECOND', CAST({sql} AS TIMESTAMP))"
    return f"CAST({sql} AS {NAMES[want]})"
