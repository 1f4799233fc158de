"""Stored tables: changes, transactions, conflicts, recovery, compaction."""

import random
import threading

import pytest

from quernel.errors import BindError, CatalogError, ConstraintError, SerializationFailure, TxnError, WriteConflict
from quernel.session import Database


@pytest.fixture
def db(spark, tmp_path):
    out = Database(spark, str(tmp_path / "db"))
    out.script("CREATE TABLE t (id INT NOT NULL, v INT, s VARCHAR(3)); INSERT INTO t VALUES (1, 10, 'a'), (2, 20, 'b'), (3, NULL, NULL)")
    return out


def all_rows(db, table="t"):
    return sorted((tuple(r) for r in db.execute(f"SELECT * FROM {table}").collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_changes_and_constraints(spark, db):
    db.execute("UPDATE t SET v = v + 1, s = 'z' WHERE v > 10")
    db.execute("DELETE FROM t WHERE v = 10")
    before = all_rows(db)
    assert before == [(2, 21, "z"), (3, None, None)]
    for sql, error in [("INSERT INTO t VALUES (4, 1, 'x'), (NULL, 1, 'y')", ConstraintError), ("INSERT INTO t VALUES (4, 1, 'éé')", ConstraintError), ("UPDATE t SET id = NULL", ConstraintError), ("UPDATE t SET v = v / 2", BindError),
                       ("INSERT INTO t VALUES (1)", BindError), ("INSERT INTO t (q) VALUES (1)", BindError), ("UPDATE t SET q = 1", BindError), ("DELETE FROM u", BindError), ("CREATE TABLE t (a INT)", CatalogError), ("DROP TABLE u", CatalogError),
                       ("DROP INDEX i", CatalogError), ("CREATE INDEX i ON t(id, v)", CatalogError), ("CREATE TABLE w (a INT, a INT)", CatalogError)]:
        with pytest.raises(error):
            db.execute(sql)
    assert all_rows(Database(spark, db.store.path)) == before


def test_transactions(spark, db):
    other = Database(spark, db.store.path)
    db.script("BEGIN; INSERT INTO t VALUES (4, 40, 'd'); DELETE FROM t WHERE id = 1")
    assert [r[0] for r in all_rows(db)] == [2, 3, 4] and [r[0] for r in all_rows(other)] == [1, 2, 3]
    with pytest.raises(TxnError):
        db.execute("BEGIN")
    with pytest.raises(ConstraintError):  # the failing statement alone is undone
        db.execute("INSERT INTO t VALUES (NULL, 1, 'x')")
    db.execute("COMMIT")
    assert [r[0] for r in all_rows(other)] == [2, 3, 4]
    db.script("BEGIN; DELETE FROM t; ROLLBACK; ROLLBACK; COMMIT")
    assert len(all_rows(db)) == 3


def test_conflicts(spark, db):
    a, b = Database(spark, db.store.path), Database(spark, db.store.path)
    db.execute("CREATE TABLE u (x INT)")
    for d in (a, b):
        d.execute("BEGIN")
    a.execute("UPDATE t SET v = 1")
    b.execute("UPDATE t SET v = 2")
    a.execute("COMMIT")
    with pytest.raises(WriteConflict):
        b.execute("COMMIT")
    assert {r[1] for r in all_rows(db)} == {1}
    # write skew: allowed by snapshots, not when serializable
    for serializable in (False, True):
        a, b = (Database(spark, db.store.path, serializable) for _ in range(2))
        for d in (a, b):
            d.execute("BEGIN")
            all_rows(d, "t"), all_rows(d, "u")
        a.execute("INSERT INTO u VALUES (1)")
        b.execute("INSERT INTO t VALUES (9, 9, '9')")
        a.execute("COMMIT")
        if serializable:
            with pytest.raises(SerializationFailure):
                b.execute("COMMIT")
        else:
            b.execute("COMMIT")


def test_crashes(spark, db, monkeypatch):
    before = all_rows(db)
    monkeypatch.setattr(db.store, "publish", lambda *a: (_ for _ in ()).throw(OSError("power")))  # data is written, the manifest isn't
    with pytest.raises(OSError):
        db.execute("DELETE FROM t")
    again = Database(spark, db.store.path)
    assert all_rows(again) == before
    store = again.store
    torn = store.fs.create(store._manifest(store.current().version + 1), False)
    torn.write(bytearray(b"half"))
    torn.close()
    assert all_rows(Database(spark, store.path)) == before
    again.execute("DELETE FROM t WHERE id = 1")  # goes on behind the torn one
    assert len(all_rows(Database(spark, store.path))) == 2
    assert again.compact() == 0 and again.compact(0) == 1
    assert len(all_rows(Database(spark, store.path))) == 2


def test_dump_and_index(spark, db, tmp_path):
    db.script("CREATE INDEX i ON t(v); CREATE TABLE w (b BOOL, d DOUBLE, s TEXT NOT NULL); INSERT INTO w VALUES (TRUE, 1, 'it''s'), (NULL, NULL, '')")
    copy = Database(spark, str(tmp_path / "copy"))
    copy.script(db.dump_sql())
    assert all_rows(copy) == all_rows(db) and all_rows(copy, "w") == all_rows(db, "w")
    with pytest.raises(CatalogError):
        db.execute("CREATE INDEX i ON t(id)")
    assert db.access_path("SELECT id FROM t WHERE v = 10") == "index" and db.access_path("SELECT id FROM t WHERE id = 1") == "scan"
    db.execute("DROP INDEX i")
    assert db.access_path("SELECT id FROM t WHERE v = 10") == "scan"


def test_lifecycle(spark, tmp_path):
    """Random changes against a plain list."""
    r, db, rows = random.Random(5), Database(spark, str(tmp_path / "l")), []
    db.execute("CREATE TABLE t (id INT, k INT, v INT)")
    for step in range(14):
        k = r.randint(0, 4)
        match r.randrange(4):
            case 0 | 1:
                new = [(step * 10 + i, r.randint(0, 4), r.choice([None, 1, 2, 3])) for i in range(3)]
                db.execute("INSERT INTO t VALUES " + ", ".join(f"({a}, {b}, {'NULL' if c is None else c})" for a, b, c in new))
                rows += new
            case 2:
                db.execute(f"UPDATE t SET v = v + 1, k = id WHERE k = {k} OR v > 2")
                rows = [(a, a, None if c is None else c + 1) if b == k or (c or 0) > 2 else (a, b, c) for a, b, c in rows]
            case 3:
                db.execute(f"DELETE FROM t WHERE NOT v <> {k}")
                rows = [x for x in rows if x[2] != k]
    key = lambda x: tuple((y is not None, y) for y in x)
    assert all_rows(Database(spark, db.store.path)) == sorted(rows, key=key)


def test_compaction_beside_a_transaction(spark, db):
    other, reader = Database(spark, db.store.path), Database(spark, db.store.path)
    other.script("BEGIN; INSERT INTO t VALUES (4, 40, 'd')")
    db.execute("CREATE TABLE u (x INT)")
    lazy = reader.execute("SELECT id FROM t")
    db.execute("INSERT INTO u VALUES (1)")
    db.script("INSERT INTO u VALUES (2)")
    assert db.compact(0) == 0  # all versions since the transaction began stay
    assert len(all_rows(other)) == 4
    other.execute("COMMIT")
    assert [r[0] for r in all_rows(db)] == [1, 2, 3, 4] and lazy.count() == 3
    db.execute("DELETE FROM t WHERE id < 3")
    old = reader.execute("SELECT id FROM t")
    db.execute("DELETE FROM t WHERE id = 3")
    assert db.compact() == 0 and old.count() == 2  # superseded within the retention time
    assert db.compact(0) > 0 and [r[0] for r in all_rows(db)] == [4]


def test_commit_between_check_and_claim(spark, db, monkeypatch):
    """Both sides of a write skew, the second commit in the middle of the first."""
    db.execute("CREATE TABLE u (x INT)")
    a, b = (Database(spark, db.store.path, True) for _ in range(2))
    for d in (a, b):
        d.execute("BEGIN")
        all_rows(d, "t"), all_rows(d, "u")
    a.execute("INSERT INTO u VALUES (1)")
    b.execute("INSERT INTO t VALUES (9, 9, '9')")
    claim = a.store._claim

    def late(*args):
        monkeypatch.setattr(a.store, "_claim", claim)
        b.execute("COMMIT")
        return claim(*args)

    monkeypatch.setattr(a.store, "_claim", late)
    with pytest.raises(SerializationFailure):
        a.execute("COMMIT")
    assert len(all_rows(db)) == 4 and not all_rows(db, "u")


def test_threads_keep_the_sum(spark, tmp_path):
    """Transfers between two accounts by threads: of those that conflict one is done, and no money is lost."""
    path = str(tmp_path / "bank")
    Database(spark, path).script("CREATE TABLE a (v INT); CREATE TABLE b (v INT); INSERT INTO a VALUES (100); INSERT INTO b VALUES (100)")
    done, odd = [], []

    def transfers(n):
        try:
            db = Database(spark, path)
            for _ in range(3):
                try:
                    db.script(f"BEGIN; UPDATE a SET v = v - {n}; UPDATE b SET v = v + {n}; COMMIT")
                    done.append(n)
                except WriteConflict:
                    db.rollback()
        except Exception as e:
            odd.append(e)

    threads = [threading.Thread(target=transfers, args=(n,)) for n in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    db = Database(spark, path)
    assert not odd and done
    assert all_rows(db, "a") == [(100 - sum(done),)] and all_rows(db, "b") == [(100 + sum(done),)]


def test_index_ranges(spark, db):
    """Files of an indexed table hold ranges that don't overlap."""
    db.load("w", spark.range(2000).selectExpr("cast(id * 7919 % 2000 as int) as k", "cast(id as int) as v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        db.execute("CREATE INDEX i ON w(k)")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    bounds = sorted((r[1], r[2]) for r in db.table("w").selectExpr("input_file_name() f", "k").groupBy("f").agg({"k": "min"}).join(db.table("w").selectExpr("input_file_name() f", "k").groupBy("f").agg({"k": "max"}), "f").collect())
    assert len(bounds) > 1 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    assert db.execute("SELECT v FROM w WHERE k >= 10 AND k < 20").count() == 10
