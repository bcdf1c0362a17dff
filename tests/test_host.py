import json

from tsqlspark.host.server import Server
from tsqlspark.session import Session
from tsqlspark.sources.place import workspace


def test_host(spark):
    server = Server(Session(spark, workspace(spark)))

    def ask(method, **params):
        return json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))

    def sql(text):
        return ask("tools/call", name="execute_sql", arguments={"sql": text})["result"]["content"][0]["text"]

    assert ask("initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert len(ask("tools/list")["result"]["tools"]) == 3
    sql("CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR)")
    assert sql("SELECT * FROM t").startswith("Empty Set (0 rows)")
    sql("INSERT INTO t VALUES (1, 'a|b'), (2, NULL)")
    assert sql("SELECT * FROM t ORDER BY id") == "| id | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 | NULL |"
    assert sql("SELEC").startswith("ERROR: ")
    assert "2 rows" in ask("tools/call", name="list_tables")["result"]["content"][0]["text"]
    assert "id INT NOT NULL PRIMARY KEY" in ask("tools/call", name="get_table_schema", arguments={"tableName": "t"})["result"]["content"][0]["text"]
    assert ask("nope")["error"]["code"] == -32601
    assert ask("tools/call", name="nope")["error"]["code"] == -32602
    assert ask("tools/call", name="execute_sql")["error"]["code"] == -32602
    assert json.loads(server.answer("{"))["error"]["code"] == -32000
