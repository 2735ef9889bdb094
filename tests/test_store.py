"""The snapshot store: states after statements, most against sqlite3."""

import sqlite3

import pytest

from tessera.errors import EngineError
from tessera.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


SCRIPT = [
    "CREATE TABLE a (id INTEGER PRIMARY KEY, x INTEGER NOT NULL DEFAULT 7, s TEXT UNIQUE, CHECK (x > 0))",
    "INSERT INTO a (id, x, s) VALUES (1, 10, 'p'), (2, 20, 'q')",
    "INSERT INTO a (s) VALUES ('r')",
    "UPDATE a SET x = x + id, s = s || '!' WHERE x >= 10",
    "INSERT INTO a SELECT id + 10, x, s || '2' FROM a WHERE id < 3",
    "DELETE FROM a WHERE id = 2",
    "REPLACE INTO a VALUES (1, 99, 'new')",
    "INSERT INTO a VALUES (3, 5, 'z'), (4, 6, 'y') ON CONFLICT (id) DO UPDATE SET x = x + excluded.x WHERE excluded.x < 100",
    "INSERT INTO a VALUES (4, 1, 'w') ON CONFLICT (id) DO NOTHING",
    "ALTER TABLE a ADD COLUMN extra TEXT DEFAULT 'e'",
    "ALTER TABLE a RENAME COLUMN x TO xx",
]


def test_state_like_sqlite(store):
    other = sqlite3.connect(":memory:")
    for statement in SCRIPT:
        store.execute(statement)
        other.execute(statement)
    want = sorted(other.execute("SELECT * FROM a").fetchall())
    assert sorted(tuple(r) for r in store.execute("SELECT * FROM a").collect()) == want


@pytest.mark.parametrize(
    ("statement", "code"),
    [
        ("INSERT INTO a (id, x) VALUES (1, 1)", "constraint"), ("INSERT INTO a (x) VALUES (-1)", "constraint"), ("INSERT INTO a (x) VALUES (NULL)", "constraint"),
        ("INSERT INTO missing VALUES (1)", "schema"), ("INSERT INTO a VALUES (1)", "schema"), ("UPDATE a SET nope = 1", "schema"), ("CREATE TABLE a (x INTEGER)", "schema"),
        ("INSERT INTO b VALUES (5)", "constraint"), ("DELETE FROM a WHERE id = 1", "constraint"), ("DROP TABLE a", "constraint"), ("COMMIT", "state"), ("EXPLODE", "unsupported"),
    ],
)
def test_errors_change_nothing(store, statement, code):
    store.execute(SCRIPT[0])
    store.execute("CREATE TABLE b (a_id INTEGER REFERENCES a(id))")
    store.execute("INSERT INTO a (id) VALUES (1)")
    store.execute("INSERT INTO b VALUES (1), (NULL)")
    with pytest.raises(EngineError) as e:
        store.execute(statement)
    assert e.value.code == code
    assert {r.table_name: r.n_rows for r in store.stats().collect()} == {"a": 1, "b": 2}
    assert store.execute("PRAGMA integrity_check").first()[0] == "ok"


def test_lossy_values_are_refused(store):
    store.execute("CREATE TABLE t (i INTEGER, d DATE)")
    store.execute("INSERT INTO t VALUES ('12', '2024-02-29')")
    for bad in ("('12x', NULL)", "(1.5, NULL)", "(1, '2024-2-1')"):
        with pytest.raises(Exception, match="can't hold"):
            store.execute(f"INSERT INTO t VALUES {bad}")
    assert store.execute("SELECT i FROM t").collect()[0][0] == 12


def test_transactions_savepoints_and_snapshots(spark, store):
    store.execute("CREATE TABLE t (i INTEGER)")
    before = store.snapshot()
    store.script("BEGIN; INSERT INTO t VALUES (1); SAVEPOINT s; INSERT INTO t VALUES (2); ROLLBACK TO s; INSERT INTO t VALUES (3); COMMIT")
    assert sorted(r[0] for r in store.execute("SELECT i FROM t").collect()) == [1, 3]
    assert before.sql("SELECT count(*) AS n FROM t").first()[0] == 0
    store.script("BEGIN; DELETE FROM t; ROLLBACK")
    assert store.execute("SELECT count(*) AS n FROM t").first()[0] == 2
    other = Store(spark, store.root)
    other.execute("INSERT INTO t VALUES (4)")
    with pytest.raises(EngineError) as e:
        store.execute("INSERT INTO t VALUES (5)")
    assert e.value.code == "conflict"
    store.refresh()
    assert store.execute("SELECT count(*) AS n FROM t").first()[0] == 3


def test_returning_and_backup(spark, store, tmp_path):
    store.execute("CREATE TABLE t (i INTEGER PRIMARY KEY, s TEXT)")
    assert [tuple(r) for r in store.execute("INSERT INTO t (s) VALUES ('a'), ('b') RETURNING i, s || '!' AS z").collect()] == [(1, "a!"), (2, "b!")]
    assert store.execute("UPDATE t SET s = 'c' WHERE i = 2 RETURNING *").collect()[0].s == "c"
    store.backup(f"file://{tmp_path}/copy")
    assert store.execute("DELETE FROM t") == 2
    assert Store(spark, f"file://{tmp_path}/copy").execute("SELECT count(*) AS n FROM t").first()[0] == 2


def test_a_half_written_manifest_is_never_seen(store, tmp_path):
    store.script("CREATE TABLE t (i INTEGER PRIMARY KEY); INSERT INTO t VALUES (1)")
    (tmp_path / "store/manifests/.left.new").write_text("")
    other = Store(store.spark, store.root)
    assert other.execute("SELECT count(*) AS n FROM t").first().n == 1
    store.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(EngineError) as e:
        other.execute("INSERT INTO t VALUES (3)")
    assert e.value.code == "conflict"


def test_rows_are_appended_and_only_these_are_checked(store, tmp_path):
    store.script("CREATE TABLE t (i INTEGER PRIMARY KEY, s TEXT, x INTEGER); CREATE INDEX by_x ON t (x DESC, s)")
    store.execute("INSERT INTO t VALUES (1, 'a', 5), (2, 'b', 7)")
    store.execute("INSERT INTO t VALUES (3, 'c', 6)")
    assert len([p for p in (tmp_path / "store/tables/t").iterdir()]) == 2
    with pytest.raises(EngineError):
        store.execute("INSERT INTO t VALUES (3, 'again', 1)")
    assert [tuple(r) for r in store.execute("SELECT rowid AS r, x FROM t ORDER BY x DESC").collect()] == [(2, 7), (3, 6), (1, 5)]
    store.script("ALTER TABLE t RENAME COLUMN x TO y; INSERT INTO t (s) SELECT s || '+' FROM t ORDER BY i; DROP INDEX by_x; VACUUM")
    assert [r.i for r in store.execute("SELECT i FROM t ORDER BY i").collect()] == [1, 2, 3, 4, 5, 6]


def test_numbering_of_selected_rows_is_the_row_order_s(store):
    other = sqlite3.connect(":memory:")
    for s in ("CREATE TABLE t (i INTEGER PRIMARY KEY, s TEXT)", "INSERT INTO t VALUES (4, 'x')", "INSERT INTO t VALUES (NULL, 'a'), (9, 'b'), (NULL, 'c'), (2, 'd'), (NULL, 'e')"):
        store.execute(s)
        other.execute(s)
    assert sorted(tuple(r) for r in store.execute("SELECT * FROM t").collect()) == sorted(other.execute("SELECT * FROM t").fetchall())
