import threading
import time

import pytest

from tsqlspark.session import Session
from tsqlspark.sources.catalog import Database
from tsqlspark.sources.place import workspace


@pytest.fixture
def s(spark):
    return Session(spark, workspace(spark))


def rows(s, sql):
    got = s.execute(sql)
    assert got.ok, got.message
    return sorted(map(tuple, got.df.collect()), key=str)


def ok(s, *statements):
    for sql in statements:
        got = s.execute(sql)
        assert got.ok, (sql, got.message)
    return got


def test_ddl_dml_and_coercion(s):
    ok(s, "CREATE TABLE e (id INT, name VARCHAR(100), pay FLOAT, on_duty BIT)", "INSERT INTO e VALUES (1, 'A|b', 75000.5, 1), (2, 'B', 8, 0)", "INSERT INTO e (id, name) VALUES (-3, 'it''s {x}')")
    assert rows(s, "SELECT * FROM e WHERE on_duty = 1") == [(1, "A|b", 75000.5, True)]
    assert rows(s, "SELECT name FROM e WHERE name = 'it''s {x}'") == [("it's {x}",)]
    assert ok(s, "UPDATE e SET id = 2.5 WHERE id = 1").affected == 1
    assert rows(s, "SELECT id FROM e WHERE on_duty = 1") == [(2,)]
    assert s.execute("INSERT INTO e VALUES (1)").kind == "arity"
    assert s.execute("INSERT INTO e (nope) VALUES (1)").kind == "name"
    assert s.execute("INSERT INTO e (id) VALUES ('x')").kind == "type"
    assert ok(s, "DELETE FROM e WHERE id = 99").affected == 0
    ok(s, "DROP TABLE e")
    assert s.execute("SELECT * FROM e").kind == "name"


def test_datetime(s):
    ok(s, "CREATE TABLE d (t DATETIME)", "INSERT INTO d VALUES ('2024-01-02T03:04:05.678'), (0), (NULL)")
    assert len(rows(s, "SELECT t FROM d WHERE t > '2024-01-01'")) == 1
    assert len(rows(s, "SELECT t FROM d WHERE t < GETDATE()")) == 2


def test_names_and_defaults(s):
    ok(s, "CREATE TABLE a (id INT, x INT)", "CREATE TABLE b (id INT, y INT)", "INSERT INTO a VALUES (1, 2)", "INSERT INTO b VALUES (1, 3)")
    assert s.sql("SELECT id, COUNT(*), SUM(x) + 1 FROM a GROUP BY id").columns == ["id", "COUNT(*)", "(SUM(x) + 1)"]
    assert s.sql("SELECT 1 + 1").columns == ["result"]
    assert rows(s, "SELECT id FROM a JOIN b ON b.id = a.id AND y > 2") == [(1,)]
    assert rows(s, "SELECT * FROM a CROSS JOIN b") == [(1, 2, 1, 3)]
    assert s.execute("SELECT z.id FROM a").kind == "name"
    assert s.execute("SELECT FOO(id) FROM a").kind == "name"
    assert s.execute("SELECT LEN(id, 1) FROM a").kind == "arity"
    assert rows(s, "SELECT (SELECT x FROM a WHERE id = 7)") == [(None,)]


def test_constraints(s):
    ok(s, "CREATE TABLE c (id INT PRIMARY KEY, n VARCHAR NOT NULL, age INT CHECK (age >= 18), mail VARCHAR UNIQUE)", "INSERT INTO c VALUES (1, 'A', 20, 'a'), (2, 'B', NULL, NULL), (3, 'C', NULL, NULL)")
    for sql, kind in (("(1, 'x', 20, 'b')", "unique"), ("(4, NULL, 20, 'b')", "not_null"), ("(4, 'x', 15, 'b')", "check"), ("(4, 'x', 20, 'a')", "unique"), ("(5, 'x', 20, 'z'), (6, 'x', 20, 'z')", "unique")):
        assert s.execute(f"INSERT INTO c VALUES {sql}").kind == kind
    assert s.execute("UPDATE c SET id = 1").kind == "unique"
    assert s.execute("UPDATE c SET age = 3 WHERE id = 1").kind == "check"
    ok(s, "UPDATE c SET id = id + 1")
    assert rows(s, "SELECT id FROM c") == [(2,), (3,), (4,)]


def test_alter(s):
    ok(s, "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)", "ALTER TABLE t ADD age INT CHECK (age > 1)")
    assert s.execute("ALTER TABLE t ADD age INT").kind == "exists"
    assert s.execute("ALTER TABLE t ADD z INT NOT NULL").kind == "not_null"
    assert s.execute("INSERT INTO t VALUES (2, 1)").kind == "check"
    ok(s, "INSERT INTO t VALUES (2, 5)", "ALTER TABLE t DROP COLUMN age", "ALTER TABLE t ADD age INT")
    assert rows(s, "SELECT * FROM t") == [(1, None), (2, None)]
    ok(s, "ALTER TABLE t DROP COLUMN age")
    assert s.execute("ALTER TABLE t DROP COLUMN id").kind == "unsupported"


def test_views(s):
    ok(s, "CREATE TABLE o (c INT, a FLOAT)", "INSERT INTO o VALUES (1, 150), (2, 80), (1, 200)", "CREATE VIEW v AS SELECT c, COUNT(*) AS n, SUM(a) AS t FROM o GROUP BY c")
    assert rows(s, "SELECT n, t FROM v WHERE n > 1") == [(2, 350.0)]
    assert s.execute("CREATE TABLE v (id INT)").kind == "exists"
    ok(s, "CREATE VIEW w AS SELECT * FROM w")
    assert s.execute("SELECT * FROM w").kind == "name"
    ok(s, "DROP VIEW v")
    assert s.execute("DROP VIEW v").kind == "name"


def test_triggers(s):
    ok(s, "CREATE TABLE o (id INT, q INT)", "CREATE TABLE l (id INT, q INT, op VARCHAR)", "CREATE TRIGGER i ON o AFTER INSERT AS INSERT INTO l SELECT id, q, 'I' FROM inserted",
       "CREATE TRIGGER u ON o AFTER UPDATE AS INSERT INTO l SELECT i.id, i.q - d.q, 'U' FROM inserted i JOIN deleted d ON i.id = d.id", "CREATE TRIGGER d ON o AFTER DELETE AS INSERT INTO l SELECT id, q, 'D' FROM deleted",
       "INSERT INTO o VALUES (1, 10), (2, 20)", "UPDATE o SET q = 25 WHERE q = 20", "DELETE FROM o WHERE id = 1")
    assert rows(s, "SELECT * FROM l") == [(1, 10, "D"), (1, 10, "I"), (2, 20, "I"), (2, 5, "U")]
    again = Session(s.spark, Database(s.spark, s.db.root))
    ok(again, "INSERT INTO o VALUES (9, 99)")
    assert (9, 99, "I") in rows(again, "SELECT * FROM l")
    assert again.execute("SELECT * FROM inserted").kind == "name"


def test_failing_trigger_undoes_the_statement(s):
    ok(s, "CREATE TABLE t (id INT)", "CREATE TABLE k (id INT PRIMARY KEY)", "INSERT INTO k VALUES (1)", "CREATE TRIGGER g ON t AFTER INSERT AS INSERT INTO k SELECT id FROM inserted")
    assert s.execute("INSERT INTO t VALUES (1)").kind == "trigger"
    assert rows(s, "SELECT * FROM t") == [] and rows(s, "SELECT * FROM k") == [(1,)]
    ok(s, "DROP TRIGGER g", "INSERT INTO t VALUES (1)")
    assert s.execute("DROP TRIGGER g").kind == "name"


def test_self_firing_trigger_ends(s):
    ok(s, "CREATE TABLE t (id INT)", "CREATE TRIGGER g ON t INSTEAD OF INSERT AS INSERT INTO t SELECT id FROM inserted")
    assert s.execute("INSERT INTO t VALUES (1)").kind == "trigger"


def test_transactions(s):
    ok(s, "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)", "BEGIN TRAN")
    assert s.execute("BEGIN").kind == "transaction"
    ok(s, "INSERT INTO t VALUES (2)", "ALTER TABLE t ADD x INT", "CREATE TABLE u (id INT)")
    assert s.execute("INSERT INTO t VALUES ('bad', 1)").kind == "type"
    assert len(rows(s, "SELECT * FROM t")) == 2
    ok(s, "ROLLBACK")
    assert rows(s, "SELECT * FROM t") == [(1,)] and s.execute("SELECT * FROM u").kind == "name"
    assert s.execute("COMMIT").kind == "transaction"


def test_reader_waits_for_open_writer(s):
    ok(s, "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)", "BEGIN", "UPDATE t SET id = 2")
    other, got = Session(s.spark, s.db), {}

    def read():
        start = time.time()
        got["rows"] = rows(other, "SELECT * FROM t")
        got["took"] = time.time() - start

    t = threading.Thread(target=read)
    t.start()
    time.sleep(0.4)
    assert "rows" not in got
    ok(s, "COMMIT")
    t.join(30)
    assert got["rows"] == [(2,)] and got["took"] >= 0.3


def test_null_rules(s):
    ok(s, "CREATE TABLE n (id INT, q INT)", "INSERT INTO n VALUES (1, 10), (2, NULL), (3, 20)")
    assert rows(s, "SELECT COUNT(*), COUNT(q), SUM(q), AVG(q) FROM n") == [(3, 2, 30, 15.0)]
    assert rows(s, "SELECT id FROM n WHERE NOT id IN (SELECT q FROM n)") == [(1,), (2,), (3,)]
    ok(s, "DELETE FROM n WHERE q > 10")
    assert rows(s, "SELECT id FROM n") == [(1,), (2,)]


def test_sessions_by_path(spark):
    root = workspace(spark)
    a, b = Session(spark, root), Session(spark, root)
    ok(a, "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)")
    ok(b, "INSERT INTO t VALUES (2)")
    assert rows(Session(spark, root), "SELECT * FROM t") == rows(a, "SELECT * FROM t") == [(1,), (2,)]
    ok(a, "BEGIN", "INSERT INTO t VALUES (3)")
    c = Session(spark, root)  # spares the files of the open transaction
    ok(a, "COMMIT")
    assert rows(c, "SELECT * FROM t") == [(1,), (2,), (3,)]
    ok(a, "BEGIN", "UPDATE t SET id = id + 10")
    ok(b, "INSERT INTO t VALUES (4)", "CREATE TABLE u (id INT)")
    assert a.execute("COMMIT").kind == "transaction"
    assert rows(c, "SELECT * FROM t") == [(1,), (2,), (3,), (4,)] and rows(a, "SELECT * FROM u") == []


def test_garbage_and_lost_files(spark):
    root = workspace(spark)
    a = Session(spark, root)
    ok(a, "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)", "BEGIN", "INSERT INTO t VALUES (2)")
    Database(spark, root, lease=0.0)  # as if the lease were over
    got = a.execute("COMMIT")
    assert not got.ok and got.kind == "transaction"
    assert rows(Session(spark, root), "SELECT * FROM t") == [(1,)]
    a.db.files.fs.create(a.db.files.path(f"{root}/manifest.json.lock"), False).close()
    with a.db.files.turn(f"{root}/manifest.json.lock", 0.0):  # a lock left behind is void
        pass


def test_one_instant_for_a_statement(s):
    ok(s, "CREATE TABLE e (id INT, at DATETIME)", "INSERT INTO e SELECT 1, GETDATE()")
    for _ in range(6):
        ok(s, "INSERT INTO e SELECT id, GETDATE() FROM e")
    assert ok(s, "UPDATE e SET id = 2 WHERE at < GETDATE()").affected == 64
    assert rows(s, "SELECT COUNT(*) FROM e") == [(64,)]
    assert len({r[0] for r in s.sql("SELECT GETDATE() FROM e").collect()}) == 1


def test_only_touched_parts_are_written_anew(s):
    ok(s, "CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR)", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t VALUES (2, 'b'), (3, 'c')")
    before = s.catalog.table("t")["parts"]
    ok(s, "UPDATE t SET s = 'z' WHERE id = 3")
    after = s.catalog.table("t")["parts"]
    assert before[0] in after and before[1] not in after
    assert s.execute("UPDATE t SET id = 1 WHERE id = 3").kind == "unique"
    ok(s, "DELETE FROM t WHERE id = 1")
    assert rows(s, "SELECT * FROM t") == [(2, "b"), (3, "z")]
