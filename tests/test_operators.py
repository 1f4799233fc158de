"""Statistics, versions, locks, checks, the shell and streams."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quernel.errors import SerializationFailure, WriteConflict
from quernel.operators import checks, locks, mvcc
from quernel.operators import stats as S
from quernel.session import Database
from quernel.shell import command
from quernel.streaming import parquet_stream


def test_q_errors(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(r.randint(0, 40), r.randint(0, 5), r.random() * 100, r.choice("abcd")) for _ in range(800)], "a int, b int, f double, s string").cache()
    db = Database(spark).register("t", df)
    db.analyze("t")
    assert db.stats["t"].rows == 800 and abs(db.stats["t"].columns["a"].ndv - 41) <= 2
    found = [db.q_error(f"SELECT a FROM t WHERE {p}")[2] for p in ("a < 10", "a = 3", "b IN (1, 2)", "f >= 25.0 AND b <> 0", "s = 'a' OR a > 30", "NOT a <= 20", "a IS NULL", "f < 10")]
    assert statistics.median(found) < 1.5
    assert S.q_error(9, 0) == 10 and S.prefers_index(0.1) and not S.prefers_index(0.3)


def test_sketch(spark):
    ndv = S.table_stats(spark.range(10_000)).columns["id"].ndv
    assert abs(ndv - 10_000) < 600


def test_join_order():
    sizes = {"big": 200.0, "small": 4.0, "mid": 30.0}
    edges = {frozenset(["big", "small"]): 1 / 100, frozenset(["small", "mid"]): 1 / 30}
    assert S.best_order(sizes, edges)[-1] == "big"
    assert S.best_order(sizes | {"alone": 1.0}, edges) == []


def test_snapshots():
    for kind in (mvcc.MvccStore, mvcc.SsiStore):
        s = kind()
        t = s.begin()
        s.update(t, "a", 1)
        s.update(t, "b", 1)
        s.commit(t)
        old, new = s.begin(), s.begin()
        s.update(new, "a", 2)
        assert s.read(old, "a") == 1 and s.read(new, "a") == 2
        with pytest.raises(WriteConflict):
            s.update(old, "a", 3)
        s.abort(old)
        s.commit(new)
        t = s.begin()
        assert s.read(t, "a") == 2
        s.update(t, "b", None)
        assert s.read(t, "b") is None
        s.abort(t)
        assert s.read(s.begin(), "b") == 1


@pytest.mark.parametrize("kind", [mvcc.MvccStore, mvcc.SsiStore])
def test_write_skew(kind):
    s = kind()
    t = s.begin()
    for k in "xy":
        s.update(t, k, 1)
    s.commit(t)
    a, b = s.begin(), s.begin()
    for t in (a, b):
        assert s.read(t, "x") + s.read(t, "y") == 2
    s.update(a, "x", 0)
    s.update(b, "y", 0)
    s.commit(a)
    if kind is mvcc.SsiStore:
        with pytest.raises(SerializationFailure):
            s.commit(b)
    else:
        s.commit(b)
        assert s.vacuum() == 2


def test_visible(spark):
    rows = [("live", 1, 0), ("gone", 1, 2), ("kept", 1, 3), ("mine gone", 1, 9), ("aborted", 3, 0), ("in flight", 4, 0), ("own", 9, 0), ("future", 12, 0)]
    status = spark.createDataFrame([(1, "C"), (2, "C"), (3, "A"), (4, "I"), (9, "I"), (12, "C")], "txn long, st string")
    v = spark.createDataFrame(rows, "name string, xmin long, xmax long")
    assert {r["name"] for r in mvcc.visible(v, status, 9, 10, [4]).collect()} == {"live", "kept", "own"}


def test_locks():
    t = locks.LockTable()
    assert t.acquire(1, "a", "S").kind == t.acquire(2, "a", "IS").kind == "granted"
    assert t.acquire(3, "a", "X").kind == "waiting"
    assert t.acquire(4, "a", "S").kind == "waiting"  # not before the third
    assert t.release(1) == [] and t.release(2) == [3] and t.release(3) == [4]
    t = locks.LockTable()
    t.acquire(1, "a", "X"), t.acquire(2, "b", "X")
    assert t.acquire(1, "b", "S").kind == "waiting"
    assert t.acquire(2, "a", "S") == locks.Answer("deadlock", 2)


def test_checks_and_shell(spark, tmp_path):
    db = Database(spark, str(tmp_path / "d"))
    db.script("CREATE TABLE p (id INT NOT NULL, s VARCHAR(4)); INSERT INTO p VALUES (1, 'a'), (1, 'b')")
    c = spark.createDataFrame([(1,), (2,), (None,)], "ref int")
    assert [r[0] for r in checks.orphans(c, "ref", db.table("p"), "id").collect()] == [2]
    assert checks.duplicates(db.table("p"), "id").collect()[0]["n"] == 2
    assert command(db, ".check").count(": 0") == 2 and "2 rows" in command(db, ".analyze p") and "CREATE TABLE p" in command(db, ".dump")


def test_stream(spark, tmp_path):
    spark.range(20).select(F.col("id"), (F.col("id") % 3).alias("k")).write.parquet(str(tmp_path / "in"))
    db = Database(spark).register("s", parquet_stream(spark, str(tmp_path / "in")))
    out = db.execute("SELECT k, COUNT(*) AS n, SUM(id) AS total FROM s WHERE id > 1 GROUP BY k")
    q = out.writeStream.outputMode("complete").format("memory").queryName("agg").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("agg").collect()) == [(0, 6, 63), (1, 6, 69), (2, 6, 57)]
