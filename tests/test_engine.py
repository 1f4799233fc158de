"""Semantics of SELECT, by table and against DuckDB with random predicates."""

import random

import duckdb
import pytest

from quernel.errors import BindError
from quernel.session import Database


@pytest.fixture(scope="module")
def db(spark):
    rows = [(1, "a", 10, 1.5), (2, "b", 20, 2.5), (3, "a", 30, None), (4, "c", None, 4.5)]
    return Database(spark).register("t", spark.createDataFrame(rows, "id long, name string, x int, p double"))


def rows(df):
    return [tuple(r) for r in df.collect()]


#: One SELECT for all: (expression, value).
VALUES = [
    ("NULL = NULL", None), ("NULL AND FALSE", False), ("NULL OR TRUE", True), ("NULL AND TRUE", None), ("NOT (NULL = 1)", None), ("NULL IS NULL", True),
    ("1 IN (2, NULL)", None), ("1 IN (1, NULL)", True), ("1 NOT IN (2, NULL)", None), ("NULL IN (1)", None), ("1 IN ('a', 1)", True), ("1 IN ('a')", False),
    ("7 / 2", 3.5), ("NULL / 0", None), ("9223372036854775807 + 1", -(1 << 63)), ("-9223372036854775807 - 3", (1 << 63) - 2), ("9223372036854775807 * 2", -2), ("5 * 7", 35), ("-(-9223372036854775807 - 1)", -(1 << 63)),
    ("1 + 1.5", 2.5), ("2147483647 + 1", 2147483648), ("-0.5", -0.5), ("+3", 3), ("'a' < 'b'", True), ("1 < 1.5", True), ("TRUE <> FALSE", True),
    ("CASE WHEN NULL THEN 1 WHEN TRUE THEN 2 END", 2), ("CASE NULL WHEN NULL THEN 1 ELSE 2 END", 2), ("CASE 1 WHEN 2 THEN 3 END", None), ("CASE WHEN FALSE THEN 1 ELSE 2.5 END", 2.5),
    ("(SELECT MAX(x) FROM t)", 30), ("(SELECT x FROM t WHERE id = 99)", None), ("3 IN (SELECT id FROM t)", True), ("9 IN (SELECT id FROM t)", False), ("9 IN (SELECT x FROM t)", None), ("NULL IN (SELECT id FROM t WHERE id > 9)", False), ("9 NOT IN (SELECT x FROM t)", None),
]


def test_values(db):
    got = db.execute("SELECT " + ", ".join(f"{e} AS v{i}" for i, (e, _) in enumerate(VALUES))).first()
    assert [(e, g) for (e, _), g in zip(VALUES, got, strict=True)] == VALUES


def test_names_and_order(db):
    assert db.execute("SELECT id, COUNT(*), SUM(x) s, 1 + 1 FROM t GROUP BY id").columns == ["id", "count", "s", "?column?"]
    assert rows(db.execute("SELECT id AS x, x AS id FROM t ORDER BY x DESC LIMIT 2")) == [(4, None), (3, 30)]
    assert rows(db.execute("SELECT x FROM t ORDER BY x DESC")) == [(30,), (20,), (10,), (None,)]
    assert rows(db.execute("SELECT id FROM t ORDER BY x, 1")) == [(4,), (1,), (2,), (3,)]
    assert rows(db.execute("SELECT DISTINCT name FROM t ORDER BY id DESC")) == [("c",), ("b",), ("a",)]
    assert rows(db.execute("SELECT a.id, b.id FROM t a JOIN t b ON a.id + 1 = b.id ORDER BY 1")) == [(1, 2), (2, 3), (3, 4)]


def test_groups(db):
    assert sorted(rows(db.execute("SELECT name, COUNT(x), SUM(x) + 1, AVG(p) FROM t GROUP BY name HAVING COUNT(*) IN (1, 2)"))) == [("a", 2, 41, 1.5), ("b", 1, 21, 2.5), ("c", 0, None, 4.5)]
    assert rows(db.execute("SELECT COUNT(*), SUM(x), MIN(name) FROM t WHERE FALSE")) == [(0, None, None)]
    assert rows(db.execute("SELECT name FROM t WHERE FALSE HAVING COUNT(*) = 0")) == [(None,)]
    assert len(rows(db.execute("SELECT COUNT(*) FROM t GROUP BY 1"))) == 1
    assert rows(db.execute("SELECT SUM(DISTINCT x + 9223372036854775800) FROM t WHERE id < 3")) == [(14,)]
    assert rows(db.execute("SELECT CASE WHEN COUNT(*) > 3 THEN 'many' END FROM t")) == [("many",)]


@pytest.mark.parametrize("sql", ["SELECT y FROM t", "SELECT id FROM u", "SELECT id FROM t a, t b", "SELECT t.id FROM t a", "SELECT id FROM t WHERE x", "SELECT id FROM t WHERE name = 1", "SELECT name + 1 FROM t", "SELECT -name FROM t", "SELECT id FROM t WHERE COUNT(*) > 1", "SELECT SUM(*) FROM t", "SELECT SUM(name) FROM t", "SELECT id FROM t ORDER BY 2", "SELECT CASE WHEN id = 1 THEN 1 ELSE 'a' END FROM t", "SELECT u.* FROM t"])
def test_bind_errors(db, sql):
    with pytest.raises(BindError):
        db.execute(sql)


def test_runtime_errors(db):
    for sql in ("SELECT id / (x - x) FROM t", "SELECT (SELECT id FROM t)"):
        with pytest.raises(Exception, match="division by zero|SCALAR_SUBQUERY"):
            db.execute(sql).collect()


class Generator:
    """Random rows and predicates."""

    columns = {"a": "int", "b": "int", "f": "double", "s": "varchar", "bo": "bool"}

    def __init__(self, seed):
        self.r = random.Random(seed)

    def value(self, kind):
        if self.r.random() < 1 / 6:
            return None
        return {"int": lambda: self.r.randint(-3, 3), "double": lambda: float(self.r.randint(-3, 3)), "varchar": lambda: "".join(self.r.choice("abc") for _ in range(self.r.randint(0, 2))), "bool": lambda: self.r.random() < 0.5}[kind]()

    def literal(self, kind):
        v = self.value(kind)
        return "NULL" if v is None else f"'{v}'" if kind == "varchar" else str(v).upper()

    def predicate(self, depth=3):
        if depth and self.r.random() < 0.6:
            op = self.r.choice(["AND", "OR", "NOT"])
            return f"(NOT {self.predicate(depth - 1)})" if op == "NOT" else f"({self.predicate(depth - 1)} {op} {self.predicate(depth - 1)})"
        c = self.r.choice(list(self.columns))
        kind, op = self.columns[c], self.r.choice(["=", "<>", "<", "<=", ">", ">="])
        match self.r.randrange(4):
            case 0:
                return f"({c} {op} {self.literal(kind)})"
            case 1:
                return f"({c} {op} {self.r.choice([k for k, v in self.columns.items() if v == kind])})"
            case 2:
                return f"({c} IS {self.r.choice(['', 'NOT '])}NULL)"
        return f"({c} {self.r.choice(['', 'NOT '])}IN ({', '.join(self.literal(kind) for _ in range(self.r.randint(1, 3)))}))"


@pytest.mark.parametrize("seed", range(6))
def test_random_predicates(spark, seed):
    """Against DuckDB, and p, NOT p and p IS NULL part the table. All predicates of a seed are one query's columns."""
    g = Generator(seed)
    data = [(i, *[g.value(k) for k in g.columns.values()]) for i in range(50)]
    df = spark.createDataFrame(data, "id long, a int, b int, f double, s string, bo boolean")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, a INT, b INT, f DOUBLE, s VARCHAR, bo BOOLEAN)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", data)
    ps = [g.predicate() for _ in range(15)]
    sql = "SELECT id, " + ", ".join(f"{p} AS p{i}" for i, p in enumerate(ps)) + " FROM t"
    db = Database(spark).register("t", df)
    assert sorted(rows(db.execute(sql))) == sorted(con.execute(sql).fetchall())
    p = ps[0]
    parts = [rows(db.execute(f"SELECT id FROM t WHERE {q}")) for q in (p, f"NOT {p}", f"{p} IS NULL")]
    assert sorted(sum(parts, [])) == [(i,) for i in range(50)]
    agg = f"SELECT a, COUNT(*) AS n, COUNT(b) AS nb, CAST(SUM(b) AS BIGINT) AS s, AVG(f) AS m, MIN(s) AS lo, MAX(bo) AS hi, COUNT(DISTINCT s) AS d FROM t WHERE {p} OR id < 25 GROUP BY a"
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(rows(db.execute(agg.replace("CAST(SUM(b) AS BIGINT)", "SUM(b)"))), key=key) == sorted(con.execute(agg).fetchall(), key=key)
