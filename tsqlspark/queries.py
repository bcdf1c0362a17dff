"""The query catalogue: what ``__spark_entry__`` registers, with SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import Session
from .sources.catalog import Database
from .sources.place import workspace

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_KEYS = "SELECT p.p_partkey AS k FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey"
_PER = "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey"

#: name: (statement, the same for DuckDB where it differs)
SELECTS: dict[str, tuple[str, str | None]] = {
    "flagship": ("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, COUNT(*) AS n FROM lineitem WHERE l_discount <= 0.05 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag", None),
    "scan_star": ("SELECT * FROM nation", None),
    "select_const": ("SELECT 1 + 2 AS a, 'x' AS b", None),
    "project_alias": ("SELECT p_partkey, p_size * 2 AS dbl FROM part", None),
    "project_implicit_alias": ("SELECT p_partkey k FROM part", None),
    "bracket_ident": ("SELECT doc_id, LEN([text]) AS n FROM documents", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents"),
    "qualified_star": ("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", None),
    "filter_cmp": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03", None),
    "filter_or_not": ("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)", None),
    "filter_ne": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority != '1-URGENT'", None),
    "filter_is_null": ("SELECT o.o_orderkey FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey WHERE p.p_name IS NULL", None),
    "filter_is_not_null": ("SELECT o.o_orderkey FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey WHERE p.p_name IS NOT NULL", None),
    "not_3vl": ("SELECT o.o_orderkey FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey WHERE NOT p.p_size > 25", None),
    "in_list": ("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)", None),
    "not_in_list": ("SELECT p_partkey FROM part WHERE NOT p_size IN (1, 5, 9)", None),
    "arith": ("SELECT l_orderkey, l_linenumber, -l_quantity AS neg, l_quantity - 1 AS m1, l_quantity / 2 AS h FROM lineitem", None),
    "arith_int": ("SELECT p_partkey, p_size / 4 AS h, p_size - 60 AS d FROM part", None),
    "concat_plus": ("SELECT n_nationkey, 'N_' + n_name AS s FROM nation", "SELECT n_nationkey, 'N_' || n_name AS s FROM nation"),
    "like_between": ("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 20", None),
    "inner_join": ("SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "left_join": ("SELECT o.o_orderkey, p.p_name FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey", None),
    "cross_join": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "multi_join": ("SELECT c.c_custkey, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "self_join": ("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", None),
    "group_by": ("SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "group_by_avg": ("SELECT l_linestatus, ROUND(AVG(l_quantity), 4) AS a FROM lineitem GROUP BY l_linestatus", None),
    "global_agg": ("SELECT COUNT(value) AS c, MIN(value) AS mn, MAX(value) AS mx FROM events", None),
    "agg_nulls": ("SELECT COUNT(*) AS n, COUNT(p.p_size) AS c, SUM(p.p_size) AS s FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey",
                  "SELECT COUNT(*) AS n, COUNT(p.p_size) AS c, CAST(SUM(p.p_size) AS BIGINT) AS s FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey"),
    "agg_expr": ("SELECT o_orderstatus, MAX(o_orderkey) - MIN(o_orderkey) AS spread FROM orders GROUP BY o_orderstatus", None),
    "agg_key_expr": ("SELECT LOWER(o_orderstatus) AS st, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", None),
    "group_distinct": ("SELECT event_type FROM events GROUP BY event_type", None),
    "having_key": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus HAVING o_orderstatus <> 'F'", None),
    "having_agg": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "order_by": ("SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name", None),
    "top_n": ("SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "scalar_subq_where": ("SELECT p_partkey FROM part WHERE p_retailprice = (SELECT MAX(p_retailprice) FROM part)", None),
    "scalar_subq_select": ("SELECT r_name, (SELECT MAX(n_nationkey) FROM nation) AS mx FROM region", None),
    "in_subq": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", None),
    "exists_corr": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE orders.o_custkey = customer.c_custkey AND o_orderstatus = 'P')", None),
    "exists_multi_corr": ("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT * FROM lineitem WHERE lineitem.l_orderkey = orders.o_orderkey AND lineitem.l_suppkey = orders.o_custkey)", None),
    "not_exists_corr": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE orders.o_custkey = customer.c_custkey AND o_orderstatus = 'P')", None),
    "exists_uncorr": ("SELECT r_name FROM region WHERE EXISTS (SELECT * FROM nation WHERE n_nationkey = 3)", None),
    "exists_in_or": ("SELECT r_name FROM region WHERE r_regionkey = 0 OR EXISTS (SELECT * FROM nation WHERE n_nationkey = 999)", None),
    "fn_string": ("SELECT n_nationkey, UPPER(n_name) AS u, LOWER(n_name) AS l, LEN(n_name) AS n FROM nation", "SELECT n_nationkey, UPPER(n_name) AS u, LOWER(n_name) AS l, CAST(length(n_name) AS INTEGER) AS n FROM nation"),
    "fn_math": ("SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(SQRT(ABS(c_acctbal)), 3) AS s, ROUND(c_acctbal) AS r FROM customer", None),
    "fn_getdate": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderdate < GETDATE()", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate < CAST(now() AS TIMESTAMP)"),
    "datetime_filter": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"),
}

#: name: (script whose last statement is the result, SQL for DuckDB)
SCRIPTS: dict[str, tuple[list[str], str]] = {
    "count_star_nulls": ([f"CREATE VIEW v_keys AS {_KEYS}", "SELECT COUNT(*) AS n FROM v_keys"], f"SELECT COUNT(*) AS n FROM ({_KEYS})"),
    "not_in_subq": ([f"CREATE VIEW v_keys AS {_KEYS}", "SELECT o_orderkey FROM orders WHERE NOT o_orderkey IN (SELECT k FROM v_keys)"],
                    f"SELECT o_orderkey FROM orders WHERE NOT o_orderkey IN (SELECT k FROM ({_KEYS}) WHERE k IS NOT NULL)"),
    "view_scan": ([f"CREATE VIEW v AS {_PER}", "SELECT * FROM v WHERE n > 5"], f"SELECT * FROM ({_PER}) WHERE n > 5"),
    "view_join": ([f"CREATE VIEW v AS {_PER}", "SELECT c.c_name, v.n FROM customer c JOIN v ON c.c_custkey = v.o_custkey"], f"SELECT c.c_name, v.n FROM customer c JOIN ({_PER}) v ON c.c_custkey = v.o_custkey"),
    "info_tables": (["CREATE TABLE a (id INT)", "CREATE TABLE b (id INT)", "SELECT * FROM INFORMATION_SCHEMA.TABLES"], "SELECT * FROM (VALUES ('a'), ('b'), " + ", ".join(f"('{t}')" for t in TABLES) + ") t(TABLE_NAME)"),
    "info_columns": (["CREATE TABLE a (id INT PRIMARY KEY, s VARCHAR)", "SELECT * FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = 'a' OR TABLE_NAME = 'labels'"],
                     "SELECT * FROM (VALUES ('a','id','INT','NO'), ('a','s','VARCHAR','YES'), ('labels','doc_id','INT','YES'), ('labels','quality','INT','YES'), ('labels','toxic','INT','YES')) t(TABLE_NAME, COLUMN_NAME, DATA_TYPE, IS_NULLABLE)"),
    "insert_values": (["CREATE TABLE t (id INT, s VARCHAR)", "INSERT INTO t VALUES (1, 'x')", "INSERT INTO t (id) VALUES (2)", "SELECT * FROM t"], "SELECT * FROM (VALUES (1,'x'), (2,NULL)) t(id, s)"),
    "insert_select": (["CREATE TABLE t (id INT, s VARCHAR)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1", "SELECT * FROM t"],
                      "SELECT n_nationkey AS id, n_name AS s FROM nation WHERE n_regionkey = 1"),
    "update_where": (["CREATE TABLE part_c (p_partkey INT, p_size INT, p_retailprice FLOAT)", "INSERT INTO part_c SELECT p_partkey, p_size, p_retailprice FROM part",
                      "UPDATE part_c SET p_size = p_size + 1, p_retailprice = p_retailprice * 2 WHERE p_size > 25", "SELECT * FROM part_c"],
                     "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part"),
    "delete_where": (["CREATE TABLE t (id INT, sz INT)", "INSERT INTO t SELECT o.o_orderkey, p.p_size FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey", "DELETE FROM t WHERE sz > 25", "SELECT * FROM t"],
                     "SELECT CAST(o.o_orderkey AS INTEGER) AS id, p.p_size AS sz FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey WHERE p.p_size IS NULL OR NOT p.p_size > 25"),
    "update_subq": (["CREATE TABLE t (n_nationkey INT, n_regionkey INT, n_name VARCHAR)", "INSERT INTO t SELECT n_nationkey, n_regionkey, n_name FROM nation",
                     "UPDATE t SET n_name = 'A' WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')", "SELECT n_nationkey, n_name FROM t"],
                    "SELECT n_nationkey, CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') THEN 'A' ELSE n_name END AS n_name FROM nation"),
    "alter_add": (["CREATE TABLE t (n_nationkey INT, n_name VARCHAR)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation", "ALTER TABLE t ADD pts INT", "SELECT * FROM t"], "SELECT n_nationkey, n_name, CAST(NULL AS INTEGER) AS pts FROM nation"),
    "alter_drop": (["CREATE TABLE t (n_nationkey INT, n_name VARCHAR)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation", "ALTER TABLE t DROP COLUMN n_name", "SELECT * FROM t"], "SELECT n_nationkey FROM nation"),
    "constraint_reject": (["CREATE TABLE parcel (code INT PRIMARY KEY, city VARCHAR NOT NULL, kilos FLOAT CHECK (kilos > 0), label VARCHAR UNIQUE)", "INSERT INTO parcel VALUES (70, 'Oslo', 2.5, 'k1')", "!INSERT INTO parcel VALUES (70, 'Bern', 1.5, 'k2')",
                           "!INSERT INTO parcel VALUES (71, NULL, 1.5, 'k2')", "!INSERT INTO parcel VALUES (71, 'Bern', -4, 'k2')", "!INSERT INTO parcel VALUES (71, 'Bern', 1.5, 'k1')", "SELECT code, city, kilos FROM parcel"],
                          "SELECT 70 AS code, 'Oslo' AS city, CAST(2.5 AS DOUBLE) AS kilos"),
    "null_marker": (["CREATE TABLE t (id INT NOT NULL, s VARCHAR NULL)", "INSERT INTO t SELECT n_nationkey, NULL FROM nation", "!INSERT INTO t VALUES (NULL, 'x')", "SELECT * FROM t"], "SELECT n_nationkey AS id, CAST(NULL AS VARCHAR) AS s FROM nation"),
    "empty_table": (["CREATE TABLE t (id INT, s VARCHAR)", "SELECT COUNT(*) AS n, MAX(id) AS m FROM t"], "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS m"),
    "drop_table": (["CREATE TABLE t (id INT, s VARCHAR)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation", "DROP TABLE t", "!SELECT * FROM t", "CREATE TABLE t (r INT)", "INSERT INTO t SELECT r_regionkey FROM region", "SELECT * FROM t"], "SELECT r_regionkey AS r FROM region"),
    "drop_view": (["CREATE VIEW v AS SELECT r_name FROM region", "DROP VIEW v", "!SELECT * FROM v", "CREATE VIEW v AS SELECT n_name FROM nation", "SELECT * FROM v"], "SELECT n_name FROM nation"),
    "drop_trigger": (["CREATE TABLE t (id INT)", "CREATE TABLE log (id INT)", "CREATE TRIGGER g ON t AFTER INSERT AS INSERT INTO log SELECT id FROM inserted", "INSERT INTO t SELECT r_regionkey FROM region", "DROP TRIGGER g",
                      "INSERT INTO t SELECT n_nationkey FROM nation", "SELECT * FROM log"], "SELECT r_regionkey AS id FROM region"),
    "first_match": (["SELECT n_name AS s, b.n_name AS other FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey"], "SELECT a.n_name AS s, b.n_name AS other FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey"),
    "delete_subq": (["CREATE TABLE t (k INT, r INT)", "INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM t WHERE r IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')", "SELECT * FROM t"],
                    "SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')"),
    "update_set_subq": (["CREATE TABLE t (k INT, r INT)", "INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation", "UPDATE t SET r = (SELECT MAX(r_regionkey) FROM region) + 1 WHERE k > 20", "SELECT * FROM t"],
                        "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 20 THEN (SELECT MAX(r_regionkey) FROM region) + 1 ELSE n_regionkey END AS r FROM nation"),
    "update_getdate": (["CREATE TABLE e (id INT, at DATETIME)", "INSERT INTO e SELECT event_id, GETDATE() FROM events", "UPDATE e SET id = id + 1 WHERE at <= GETDATE()", "SELECT COUNT(*) AS n, SUM(id) AS s FROM e"],
                       "SELECT COUNT(*) AS n, CAST(SUM(event_id + 1) AS BIGINT) AS s FROM events"),
    "update_falsifies": (["CREATE TABLE p (id INT, sz INT)", "CREATE TABLE log (id INT, was INT, now INT)", "INSERT INTO p SELECT p_partkey, p_size FROM part",
                          "CREATE TRIGGER g ON p AFTER UPDATE AS INSERT INTO log SELECT i.id, d.sz, i.sz FROM inserted i JOIN deleted d ON i.id = d.id", "UPDATE p SET sz = 0 - sz WHERE sz > 25", "SELECT * FROM log"],
                         "SELECT CAST(p_partkey AS INTEGER) AS id, p_size AS was, -p_size AS now FROM part WHERE p_size > 25"),
    "update_some_parts": (["CREATE TABLE t (k INT, s VARCHAR)", "INSERT INTO t SELECT r_regionkey, 'r' FROM region", "INSERT INTO t SELECT n_nationkey + 100, 'n' FROM nation", "INSERT INTO t SELECT n_nationkey + 200, 'm' FROM nation",
                           "UPDATE t SET s = 'x' WHERE k = 103", "DELETE FROM t WHERE k > 220", "SELECT * FROM t"],
                          "SELECT r_regionkey AS k, 'r' AS s FROM region UNION ALL SELECT n_nationkey + 100, CASE WHEN n_nationkey = 3 THEN 'x' ELSE 'n' END FROM nation UNION ALL SELECT n_nationkey + 200, 'm' FROM nation WHERE n_nationkey <= 20"),
    "trigger_instead_update": (["CREATE TABLE b (id INT, s VARCHAR)", "CREATE TABLE log (id INT, s VARCHAR)", "INSERT INTO b SELECT n_nationkey, n_name FROM nation", "CREATE TRIGGER g ON b INSTEAD OF UPDATE AS INSERT INTO log SELECT id, s FROM inserted",
                                "UPDATE b SET s = 'z' WHERE id < 3", "SELECT b.id, b.s, log.s AS asked FROM b LEFT JOIN log ON b.id = log.id"],
                               "SELECT n_nationkey AS id, n_name AS s, CASE WHEN n_nationkey < 3 THEN 'z' END AS asked FROM nation"),
    "trigger_instead_delete": (["CREATE TABLE b (id INT)", "CREATE TABLE log (id INT)", "INSERT INTO b SELECT n_nationkey FROM nation", "CREATE TRIGGER g ON b INSTEAD OF DELETE AS INSERT INTO log SELECT id FROM deleted",
                                "DELETE FROM b WHERE id < 3", "SELECT b.id, log.id AS asked FROM b LEFT JOIN log ON b.id = log.id"], "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 3 THEN n_nationkey END AS asked FROM nation"),
    "tx_trigger_rollback": (["CREATE TABLE t (id INT)", "CREATE TABLE log (id INT)", "CREATE TRIGGER g ON t AFTER INSERT AS INSERT INTO log SELECT id FROM inserted", "INSERT INTO t SELECT r_regionkey FROM region", "BEGIN TRAN",
                             "INSERT INTO t SELECT n_nationkey FROM nation", "ROLLBACK", "SELECT * FROM log"], "SELECT r_regionkey AS id FROM region"),
    "tx_ddl": (["CREATE TABLE t (id INT)", "INSERT INTO t SELECT r_regionkey FROM region", "BEGIN TRAN", "CREATE TABLE u (id INT)", "ALTER TABLE t ADD x INT", "DROP TABLE t", "ROLLBACK", "!SELECT * FROM u", "SELECT * FROM t"], "SELECT r_regionkey AS id FROM region"),
    "trigger_after": (["CREATE TABLE r (id INT, name VARCHAR)", "CREATE TABLE log (id INT, op VARCHAR)", "CREATE TRIGGER g ON r AFTER INSERT AS INSERT INTO log SELECT id, 'INS' FROM inserted",
                       "INSERT INTO r SELECT r_regionkey, r_name FROM region", "SELECT * FROM log"], "SELECT r_regionkey AS id, 'INS' AS op FROM region"),
    "trigger_update_join": (["CREATE TABLE p (id INT, sz INT)", "CREATE TABLE log (id INT, delta INT)", "INSERT INTO p SELECT p_partkey, p_size FROM part",
                             "CREATE TRIGGER g ON p AFTER UPDATE AS INSERT INTO log SELECT i.id, i.sz - d.sz FROM inserted i JOIN deleted d ON i.id = d.id", "UPDATE p SET sz = sz + 5 WHERE sz > 25", "SELECT * FROM log"],
                            "SELECT CAST(p_partkey AS INTEGER) AS id, 5 AS delta FROM part WHERE p_size > 25"),
    "trigger_instead": (["CREATE TABLE b (id INT, s VARCHAR)", "CREATE TABLE shadow (id INT, s VARCHAR)", "CREATE TRIGGER g ON b INSTEAD OF INSERT AS INSERT INTO shadow SELECT id, UPPER(s) FROM inserted",
                         "INSERT INTO b SELECT n_nationkey, n_name FROM nation", "SELECT * FROM shadow"], "SELECT n_nationkey AS id, UPPER(n_name) AS s FROM nation"),
    "trigger_cascade": (["CREATE TABLE t1 (id INT)", "CREATE TABLE t2 (id INT)", "CREATE TABLE t3 (id INT)", "CREATE TRIGGER g1 ON t1 AFTER INSERT AS INSERT INTO t2 SELECT id FROM inserted",
                         "CREATE TRIGGER g2 ON t2 AFTER INSERT AS INSERT INTO t3 SELECT id FROM inserted", "INSERT INTO t1 SELECT r_regionkey FROM region", "SELECT * FROM t3"], "SELECT r_regionkey AS id FROM region"),
    "tx_commit": (["CREATE TABLE t (id INT)", "BEGIN TRANSACTION", "INSERT INTO t SELECT n_nationkey FROM nation", "COMMIT", "SELECT * FROM t"], "SELECT n_nationkey AS id FROM nation"),
    "tx_rollback": (["CREATE TABLE t (id INT)", "CREATE TABLE log (id INT)", "CREATE TRIGGER g ON t AFTER INSERT AS INSERT INTO log SELECT id FROM inserted", "INSERT INTO t SELECT r_regionkey FROM region", "BEGIN TRAN",
                     "INSERT INTO t VALUES (99)", "UPDATE t SET id = id + 100", "DELETE FROM t WHERE id > 101", "ROLLBACK", "SELECT * FROM t"], "SELECT r_regionkey AS id FROM region"),
}


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark, workspace(spark)).read_tables(sf_dir, *TABLES)


def _select(text: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import re

        s = Session(spark, workspace(spark))
        return s.read_tables(sf_dir, *[t for t in TABLES if re.search(rf"\b{t}\b", text)]).sql(text)

    return run


def _script(steps: list[str]) -> Callable:
    """Steps that start with an exclamation mark must fail."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        for step in steps[:-1]:
            if step[0] != "!":
                s.run(step)
            elif s.execute(step[1:]).ok:
                raise AssertionError(f"accepted: {step[1:]}")
        return s.sql(steps[-1])

    return run


def trigger_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.run("CREATE TABLE t (id INT)")
    s.run("CREATE TABLE log (n INT)")
    s.on("t", "INSERT", lambda own, rows: own.run(f"INSERT INTO log VALUES ({rows.count()})"))
    s.run("INSERT INTO t SELECT r_regionkey FROM region")
    return s.sql("SELECT SUM(n) AS n FROM log")


def crash_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workspace(spark)
    s = Session(spark, root).read_tables(sf_dir, *TABLES)
    s.run("CREATE TABLE t (id INT)")
    s.run("INSERT INTO t SELECT n_nationkey FROM nation")
    s.db.write(s.sql("SELECT id + 1000 AS id FROM t"))  # written, never published
    return Session(spark, Database(spark, root)).sql("SELECT * FROM t")


def two_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions opened by path: neither loses what the other has published, a live transaction
    keeps its files, and of two that change one entry the later one is refused."""
    root = workspace(spark)
    one = Session(spark, root).read_tables(sf_dir, "region")
    one.run("CREATE TABLE t (id INT)")
    two = Session(spark, root)
    two.run("INSERT INTO t VALUES (100)")
    one.run("BEGIN TRAN")
    one.run("INSERT INTO t SELECT r_regionkey FROM region")
    three = Session(spark, root)
    one.run("COMMIT")
    three.run("BEGIN TRAN")
    three.run("INSERT INTO t VALUES (-1)")
    two.run("INSERT INTO t VALUES (101)")
    if three.execute("COMMIT").ok:
        raise AssertionError("a change that another session has overtaken was published")
    return Session(spark, root).sql("SELECT * FROM t")


def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected rows of each kind of statement."""
    s = session(spark, sf_dir)
    s.run("CREATE TABLE t (id INT, sz INT)")
    steps = {"insert": "INSERT INTO t SELECT p_partkey, p_size FROM part", "update": "UPDATE t SET sz = sz + 1 WHERE sz > 25", "delete": "DELETE FROM t WHERE sz > 40", "none": "DELETE FROM t WHERE id = -1"}
    return spark.createDataFrame([(k, s.run(sql).affected) for k, sql in steps.items()], "step string, n long")


def host_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the host's tools say about a registered table, line by line."""
    import json

    from .host.server import Server

    server = Server(Session(spark, workspace(spark)).read_tables(sf_dir, "region"))
    lines = []
    for tool, args in (("list_tables", {}), ("get_table_schema", {"tableName": "region"}), ("execute_sql", {"sql": "SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 2 ORDER BY r_regionkey"})):
        got = json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": args}})))
        lines += [(tool, i, x) for i, x in enumerate(got["result"]["content"][0]["text"].split("\n"))]
    return spark.createDataFrame(lines, "tool string, nth int, line string")


FUNCTIONS = {
    "trigger_callback": (trigger_callback, "SELECT COUNT(*) AS n FROM region"),
    "crash_recover": (crash_recover, "SELECT n_nationkey AS id FROM nation"),
    "two_sessions": (two_sessions, "SELECT r_regionkey AS id FROM region UNION ALL VALUES (100), (101)"),
    "affected_rows": (affected, "SELECT 'insert' AS step, COUNT(*) AS n FROM part UNION ALL SELECT 'update', COUNT(*) FROM part WHERE p_size > 25 UNION ALL SELECT 'delete', COUNT(*) FROM part WHERE p_size > 39 UNION ALL SELECT 'none', 0"),
    "host_answers": (host_answers, "SELECT 'list_tables' AS tool, 0 AS nth, 'region (r_regionkey INT, r_name VARCHAR), registered, ' || COUNT(*) || ' rows' AS line FROM region"
                     " UNION ALL VALUES ('get_table_schema', 0, 'r_regionkey INT'), ('get_table_schema', 1, 'r_name VARCHAR'), ('execute_sql', 0, '| r_regionkey | r_name |'), ('execute_sql', 1, '| --- | --- |')"
                     " UNION ALL SELECT 'execute_sql', r_regionkey + 2, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region WHERE r_regionkey < 2"),
}


def queries() -> dict[str, Callable]:
    out = {name: _select(text) for name, (text, _) in SELECTS.items()}
    out |= {name: _script(steps) for name, (steps, _) in SCRIPTS.items()}
    return out | {name: run for name, (run, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql or text for name, (text, sql) in SELECTS.items()} | {name: sql for name, (_, sql) in SCRIPTS.items()}
    return out | {name: sql for name, (_, sql) in FUNCTIONS.items()}
