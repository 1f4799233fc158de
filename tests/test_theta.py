"""Joins on few keys and a further condition: the same rows however they are dealt out, and no task has most of the work."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quernel.operators import theta
from quernel.session import Database


def test_one_key_is_dealt_out(spark):
    """One file and one key: one task compared all pairs."""
    a = spark.range(0, 24000, 1, 1).select("id", (F.col("id") % 1).alias("k"), (F.col("id") % 3000).cast("double").alias("v"))
    b = spark.range(0, 3000, 1, 1).select("id", (F.col("id") % 1).alias("k"), F.col("id").cast("double").alias("w"))
    db = Database(spark).register("a", a).register("b", b)
    for sql in ("SELECT a.id, b.id FROM a JOIN b ON a.k = b.k AND a.v > b.w + 1000", "SELECT a.id, b.id FROM b, a WHERE b.w + 1000 < a.v AND b.k = a.k"):
        out = db.execute(sql).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in out) == 8 * sum(v - 1000 for v in range(1001, 3000))
        assert max(r["count"] for r in out) < 0.6 * sum(r["count"] for r in out)


SPECIAL = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1e308, -1e308]


@pytest.mark.parametrize("seed", range(2))
def test_same_rows_as_plain(spark, monkeypatch, seed):
    r = random.Random(seed)
    far = seed % 2  # whether values beyond all windows occur

    def table(n):
        value = lambda: r.choice(SPECIAL) if far and r.random() < 0.1 else None if r.random() < 0.05 else r.choice([r.uniform(-50, 50), float(r.randint(-5, 5)), 7.0])
        rows = [(i, r.choice([1, 1, 1, 2, 3, None]), r.choice("ab"), value(), r.randint(-9, 9)) for i in range(n)]
        return spark.createDataFrame(rows, "id long, k int, s string, v double, i int")

    # twice the same row
    db = Database(spark).register("a", (x := table(250)).union(x.limit(30)).cache()).register("b", table(90).cache())
    tables = itertools.cycle([("a", "b"), ("b", "a")])
    conditions = [f"x.k = y.k AND x.v {op} y.v + {r.randint(-20, 20)}" for op in (">", ">=", "<", "<=")]
    conditions += ["y.k + 0 = x.k AND y.i < x.v", "x.k = y.k AND x.s = y.s AND x.i >= y.i", "x.k = y.k AND x.v - y.v > 10", "x.v = y.v AND x.id <> y.id", "x.k = y.k AND x.v > y.v AND x.i + y.i > 3 AND x.s = 'a'"]
    queries = [f"SELECT x.id, y.id, x.v, y.s FROM {p} x JOIN {q} y ON {c}" for c in conditions for p, q in [next(tables)]]
    queries += ["SELECT x.id, y.id, x.v, z.s FROM a x, b y, b z WHERE x.k = y.k AND x.v < y.v AND y.id = z.id AND z.i > 0"]
    dealt = []
    plain = theta.join
    monkeypatch.setattr(theta, "join", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    found = []
    for few in (False, True):
        if few:
            for name, n in (("WORTH", 1), ("PER_ROW", 0), ("PAIRS", 50 + 200 * (seed % 2)), ("FEW", 4), ("HEAVY", 20)):
                monkeypatch.setattr(theta, name, n)
        found.append([sorted(map(repr, db.execute(q).collect())) for q in queries])
        assert [d is not None for d in dealt] == [few] * len(queries)
        dealt.clear()
    assert found[0] == found[1]
