"""The function list: name -> (least arguments, most, Spark SQL of the arguments, type of the argument types)."""

from __future__ import annotations

from ..errors import SqlError

_same = lambda kinds: kinds[0]
FUNCTIONS = {
    "LEN": (1, 1, lambda a: f"length({a[0]})", lambda k: "INT"),
    "LENGTH": (1, 1, lambda a: f"length({a[0]})", lambda k: "INT"),
    "UPPER": (1, 1, lambda a: f"upper({a[0]})", lambda k: "VARCHAR"),
    "LOWER": (1, 1, lambda a: f"lower({a[0]})", lambda k: "VARCHAR"),
    "ABS": (1, 1, lambda a: f"abs({a[0]})", _same),
    "SQRT": (1, 1, lambda a: f"sqrt({a[0]})", lambda k: "FLOAT"),
    "ROUND": (1, 2, lambda a: f"round({', '.join(a)})", _same),
    "GETDATE": (0, 0, lambda a: "current_timestamp()", lambda k: "DATETIME"),
    "CURRENT_TIMESTAMP": (0, 0, lambda a: "current_timestamp()", lambda k: "DATETIME"),
    "COUNT": (1, 1, lambda a: f"count({a[0]})", lambda k: "INT"),
    "SUM": (1, 1, lambda a: f"sum({a[0]})", _same),
    "AVG": (1, 1, lambda a: f"avg({a[0]})", lambda k: "FLOAT"),
    "MIN": (1, 1, lambda a: f"min({a[0]})", _same),
    "MAX": (1, 1, lambda a: f"max({a[0]})", _same),
}


def call(name: str, args: list[str], kinds: list[str]) -> tuple[str, str]:
    known = FUNCTIONS.get(name.upper())
    if known is None:
        raise SqlError("name", f"there is no function {name}")
    least, most, sql, kind = known
    if not least <= len(args) <= most:
        raise SqlError("arity", f"{name} takes {least if least == most else f'{least} to {most}'} arguments, not {len(args)}")
    return sql(args), kind(kinds or [""])
