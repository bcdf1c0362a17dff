"""One JSON request a line in, one answer a line out; requests are served in turn.

Run as ``python -m tsqlspark.host.server ROOT [PARQUET_FOLDER]``.
"""

from __future__ import annotations

import json
import sys

from ..session import Session
from .markdown import markdown

PROTOCOL = "2024-11-05"
_TEXT = {"type": "string"}
TOOLS = [
    {"name": "execute_sql", "description": "Runs one SQL statement", "inputSchema": {"type": "object", "properties": {"sql": _TEXT}, "required": ["sql"]}},
    {"name": "list_tables", "description": "Tables with columns, storage and row counts", "inputSchema": {"type": "object", "properties": {}}},
    {"name": "get_table_schema", "description": "Columns and constraints of a table", "inputSchema": {"type": "object", "properties": {"tableName": _TEXT}, "required": ["tableName"]}},
]


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Server:
    def __init__(self, session: Session):
        self.session = session

    def answer(self, line: str) -> str | None:
        """The answer to one request; None to notifications."""
        number = None
        try:
            try:
                request = json.loads(line)
                number = request.get("id")
                method = request["method"]
            except (ValueError, KeyError, AttributeError) as e:
                raise RpcError(-32000, f"not a request: {e}") from e
            if number is None and method.startswith("notifications/"):
                return None
            out = {"result": self.call(method, request.get("params") or {})}
        except RpcError as e:
            out = {"error": {"code": e.code, "message": str(e)}}
        except Exception as e:
            out = {"error": {"code": -32603, "message": str(e)}}
        return json.dumps({"jsonrpc": "2.0", "id": number} | out)

    def call(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tsqlspark", "version": "1"}}
        if method == "tools/list":
            return {"tools": TOOLS}
        if method != "tools/call":
            raise RpcError(-32601, f"there is no method {method}")
        args = params.get("arguments") or {}
        name = params.get("name")
        if name == "execute_sql":
            text = self.execute(self._need(args, "sql"))
        elif name == "list_tables":
            text = self.tables()
        elif name == "get_table_schema":
            text = self.schema(self._need(args, "tableName"))
        else:
            raise RpcError(-32602, f"there is no tool {name}")
        return {"content": [{"type": "text", "text": text}], "isError": text.startswith("ERROR: ")}

    @staticmethod
    def _need(args: dict, key: str) -> str:
        if not isinstance(args.get(key), str):
            raise RpcError(-32602, f"{key} is missing")
        return args[key]

    def execute(self, sql: str) -> str:
        got = self.session.execute(sql)
        if not got.ok:
            return f"ERROR: {got.message}"
        try:
            return markdown(got.df) if got.df is not None else got.message
        except Exception as e:
            return f"ERROR: {str(e).splitlines()[0]}"

    def tables(self) -> str:
        out = []
        for t in self.session.all_tables():
            n = self.session.resolve(t["name"]).count()  # from the files' footers, without reading rows
            where = "registered" if t["parts"] is None else f"{len(t['parts'])} parts in {self.session.db.root}"
            out.append(f"{t['name']} ({', '.join(c['name'] + ' ' + c['type'] for c in t['columns'])}), {where}, {n} rows")
        return "\n".join(out) or "no tables"

    def schema(self, name: str) -> str:
        found = next((t for t in self.session.all_tables() if t["name"].lower() == name.lower()), None)
        if found is None:
            return f"ERROR: there is no table {name}"
        lines = []
        for c in found["columns"]:
            extra = [w for w, on in (("NOT NULL", not c["nullable"]), ("PRIMARY KEY", c["primary"]), ("UNIQUE", c["unique"] and not c["primary"])) if on]
            lines.append(" ".join([c["name"], c["type"], *extra, *([f"CHECK ({c['check']})"] if c["check"] else [])]))
        return "\n".join(lines)

    def serve(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip() and (text := self.answer(line)) is not None:
                print(text, file=out, flush=True)


def main(argv: list[str]) -> None:
    import os

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session = Session(spark, argv[0])
    for name in sorted(os.listdir(argv[1])) if len(argv) > 1 else []:
        if name.endswith(".parquet"):
            session.read_tables(argv[1], name.removesuffix(".parquet"))
    Server(session).serve()


if __name__ == "__main__":
    main(sys.argv[1:])
