"""Results as Markdown tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame


def _cell(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v).replace("|", "\\|").replace("\r", "").replace("\n", " ")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """The first ``most`` rows, and a line that tells if there are more; timestamps in the session's time zone (UTC)."""
    rows = df.limit(most + 1).collect()
    more, rows = len(rows) > most, rows[:most]
    names = df.columns
    if not rows:
        return f"Empty Set (0 rows)\n\nColumns: {', '.join(names)}"
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *(line([_cell(v) for v in r]) for r in rows), *([f"\nOnly the first {most} rows are shown; there are more."] if more else [])])

