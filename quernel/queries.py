"""The queries that the driver runs, in the engine's dialect, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import checks, mvcc
from quernel.session import Database
from quernel.sources.snapshots import Store

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: name: SQL of the dialect, and DuckDB's SQL where that must be written in another way.
SELECTS: dict[str, str | tuple[str, str]] = {
    "scan_project": "SELECT o_orderkey, o_totalprice AS price FROM orders",
    "star_expand": "SELECT * FROM nation",
    "star_qualified": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "filter_cmp": "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_custkey <= 700",
    "filter_and_or_not": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity < 25 OR l_discount >= 0.05) AND (l_returnflag = 'R' OR l_linestatus <> 'O')",
    "filter_text": "SELECT c_custkey FROM customer WHERE c_mktsegment >= 'F' AND c_mktsegment < 'M'",
    "is_null": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
    "is_not_null": "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END IS NOT NULL AS credit FROM supplier",
    "in_list": "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3, 1 + 1)",
    "not_in_list": "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 3)",
    "not_in_list_null": "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, NULL)",
    "in_list_value": "SELECT n_nationkey, n_regionkey IN (1, NULL) AS found FROM nation",
    "in_subquery": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "not_in_subquery_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey END FROM nation)",
    "in_subquery_value": "SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) THEN 1 ELSE 0 END AS rich FROM nation",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey < 100)",
    "scalar_subquery_empty": "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = 99) AS missing FROM nation",
    "case_searched": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders",
    "case_no_else": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name END AS name FROM nation",
    "arith_int": (
        "SELECT n_nationkey, n_nationkey + 2 * n_regionkey - 1 AS a, n_nationkey + 9223372036854775800 AS wrapped FROM nation",
        "SELECT n_nationkey, CAST(n_nationkey + 2 * n_regionkey - 1 AS BIGINT) AS a, CAST(CASE WHEN n_nationkey + 9223372036854775800::HUGEINT > 9223372036854775807 THEN n_nationkey + 9223372036854775800::HUGEINT - 18446744073709551616 ELSE n_nationkey + 9223372036854775800::HUGEINT END AS BIGINT) AS wrapped FROM nation",
    ),
    "arith_double": "SELECT l_orderkey, l_linenumber, l_quantity * 2.0 + 1 AS a, l_quantity - 0.5 AS b FROM lineitem",
    "div_int": ("SELECT o_orderkey, o_orderkey / 4 AS quarter FROM orders", "SELECT o_orderkey, o_orderkey / 4.0::DOUBLE AS quarter FROM orders"),
    "neg": "SELECT s_suppkey, -s_acctbal AS debt, -s_nationkey AS n, +s_suppkey AS same FROM supplier",
    "no_from": ("SELECT 1 + 1 AS two, 'it''s' AS text, NULL IS NULL AS yes", "SELECT 2::BIGINT AS two, 'it''s' AS text, true AS yes"),
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "join_left_null_keys": "SELECT n.n_nationkey, s.s_suppkey FROM nation n LEFT OUTER JOIN supplier s ON CASE WHEN n.n_regionkey > 2 THEN n.n_nationkey END = s.s_nationkey",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'",
    "join_theta": "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_compound_on": "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal + 9000",
    "join_self": "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey + 1 = b.r_regionkey",
    "join_3way": "SELECT n.n_name, COUNT(*) AS orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_4way": "SELECT r.r_name, COUNT(*) AS n, COUNT(DISTINCT c.c_custkey) AS customers FROM orders o, customer c, nation n, region r WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "join_5way": "SELECT r.r_name, s.s_nationkey, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_orderstatus = 'F' GROUP BY r.r_name, s.s_nationkey",
    "agg_global": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS lines, SUM(l_quantity) AS qty, MIN(l_shipdate) AS first, MAX(l_orderkey) AS last FROM lineitem", "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines, SUM(l_quantity) AS qty, MIN(l_shipdate) AS first, MAX(l_orderkey) AS last FROM lineitem"),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(n_nationkey) AS s, AVG(n_nationkey) AS a, MIN(n_name) AS m FROM nation WHERE n_nationkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(n_nationkey) AS BIGINT) AS s, AVG(n_nationkey) AS a, MIN(n_name) AS m FROM nation WHERE n_nationkey < 0"),
    "agg_group": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, SUM(o_custkey) AS s FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY ALL"),
    "agg_group_expr": ("SELECT p_size + 1 AS size, COUNT(*) AS n FROM part GROUP BY p_size + 1", "SELECT CAST(p_size + 1 AS BIGINT) AS size, COUNT(*) AS n FROM part GROUP BY p_size + 1"),
    "agg_group_null": "SELECT CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k, COUNT(*) AS n FROM nation GROUP BY CASE WHEN n_regionkey > 1 THEN n_regionkey END",
    "agg_min_max_text": "SELECT c_mktsegment, MIN(c_name) AS first, MAX(c_name) AS last FROM customer GROUP BY c_mktsegment",
    "agg_count_expr": "SELECT c_nationkey, COUNT(CASE WHEN c_acctbal > 5000 THEN 1 END) AS rich FROM customer GROUP BY c_nationkey",
    "agg_count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_sum_distinct": ("SELECT SUM(DISTINCT o_custkey) AS s FROM orders", "SELECT CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s FROM orders"),
    "agg_avg_distinct": "SELECT AVG(DISTINCT l_quantity) AS a FROM lineitem",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15 AND MAX(o_totalprice) > 100000",
    "agg_having_in": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) IN (55, 60, 61) OR c_nationkey IN (1, 2)",
    "agg_arith": ("SELECT n_regionkey, SUM(n_nationkey) + COUNT(*) * 2 AS x FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(SUM(n_nationkey) + COUNT(*) * 2 AS BIGINT) AS x FROM nation GROUP BY n_regionkey"),
    "agg_case": "SELECT p_brand, CASE WHEN COUNT(*) > 80 THEN 'many' ELSE 'few' END AS size FROM part GROUP BY p_brand",
    "agg_wrap": ("SELECT SUM(o_orderkey + 9223372036854770000) AS s FROM orders", "SELECT CAST(CASE WHEN x > 9223372036854775807 THEN x - 18446744073709551616 ELSE x END AS BIGINT) AS s FROM (SELECT SUM(CAST(o_orderkey AS HUGEINT) + 9223372036854770000) % 18446744073709551616 AS x FROM orders)"),
    "agg_bare_column": ("SELECT n.n_regionkey, r.r_name, COUNT(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_regionkey", "SELECT n.n_regionkey, ANY_VALUE(r.r_name) AS r_name, COUNT(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_regionkey"),
    "having_without_group": "SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders HAVING COUNT(*) > 3",
    "distinct": "SELECT DISTINCT o_orderstatus FROM orders",
    "distinct_multi": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "distinct_hidden_order": ("SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_custkey LIMIT 3", "SELECT c_mktsegment FROM (SELECT c_mktsegment, MIN(c_custkey) AS k FROM customer GROUP BY c_mktsegment) ORDER BY k LIMIT 3"),
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "order_desc_nulls": ("SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k FROM nation ORDER BY k DESC, n_nationkey LIMIT 18", "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k FROM nation ORDER BY k DESC NULLS LAST, n_nationkey LIMIT 18"),
    "order_asc_nulls": ("SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k FROM nation ORDER BY k, n_nationkey LIMIT 12", "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k FROM nation ORDER BY k NULLS FIRST, n_nationkey LIMIT 12"),
    "order_hidden": "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    "order_position": "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY 1 DESC, 2 LIMIT 15",
    "order_alias_first": ("SELECT o_orderkey AS o_custkey, o_custkey AS b FROM orders ORDER BY o_custkey LIMIT 10", "SELECT o_orderkey AS o_custkey, o_custkey AS b FROM orders ORDER BY o_orderkey LIMIT 10"),
    "limit_zero": "SELECT n_name FROM nation LIMIT 0",
    "point_lookup": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7",
    "hash_join": "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey",
    "tlp_all": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > 10 OR NOT l_quantity > 10 OR (l_quantity > 10) IS NULL",
    "q1": ("SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_price, AVG(l_discount) AS avg_discount FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag",) * 2,
    "q1_having": "SELECT l_returnflag, SUM(l_quantity) AS sum_qty, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag HAVING COUNT(*) > 20000",
    "q3": ("SELECT o.o_orderkey, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10",) * 2,
    "q6": ("SELECT SUM(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_discount >= 0.02 AND l_discount <= 0.04 AND l_quantity < 24",) * 2,
}
#: Doubles that are rounded on both sides, as engines add them in different orders.
ROUNDED = {"q1": {"sum_price": 2, "avg_discount": 6}, "q3": {"revenue": 2}, "q6": {"revenue": 2}}


_databases: dict[tuple, Database] = {}


def database(spark: SparkSession, sf_dir: str) -> Database:
    """The driver's tables; one database for a session and folder."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _databases:
        _databases[key] = Database(spark).register_parquet(sf_dir, *TABLES)
    return _databases[key]


def _select(name: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = database(spark, sf_dir).execute(sql)
        return out.withColumns({c: F.round(c, d) for c, d in ROUNDED.get(name, {}).items()})

    return run


def stored(spark: SparkSession) -> Database:
    """A new database in the warehouse."""
    return Database(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/quernel/{uuid.uuid4().hex}")


def orders(spark: SparkSession, sf_dir: str) -> Database:
    """A stored copy of some columns of orders."""
    return stored(spark).load("o", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))


ALL = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM o"


def insert_values(spark, sf_dir):
    db = stored(spark)
    db.script("CREATE TABLE t (id BIGINT PRIMARY KEY, n INT, d DOUBLE, ok BOOL, s VARCHAR(8)); INSERT INTO t VALUES (1, 3000000000, 2, TRUE, 'a;b'), (2, NULL, 1.5, NULL, ''), (2, -1, -0.5, FALSE, 'it''s')")
    return db.execute("SELECT * FROM t")


def insert_partial_cols(spark, sf_dir):
    db = stored(spark)
    db.script("CREATE TABLE t (id BIGINT, n INT, s TEXT); INSERT INTO t (s, id) VALUES ('x', 1 + 1); INSERT INTO t (n) VALUES (7)")
    return db.execute("SELECT * FROM t")


def update_where(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.execute("UPDATE o SET o_custkey = o_custkey + 1, o_orderstatus = 'X' WHERE o_totalprice > 200000 AND o_custkey <> 10")
    return db.execute(ALL)


def update_all(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.execute("UPDATE o SET o_custkey = CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey END")
    return db.execute(ALL)


def delete_where(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.execute("DELETE FROM o WHERE o_orderstatus = 'O' OR o_custkey IN (SELECT o_custkey FROM o WHERE o_totalprice > 400000)")
    return db.execute(ALL)


def delete_all(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.execute("DELETE FROM o")
    return db.execute("SELECT COUNT(*) AS n FROM o")


def drop_create(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.script("CREATE INDEX i ON o(o_custkey); DROP INDEX i; DROP TABLE o; CREATE TABLE o (a INT); INSERT INTO o VALUES (1)")
    return db.execute("SELECT a FROM o")


def txn_commit(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.script("BEGIN; DELETE FROM o WHERE o_orderkey > 100; UPDATE o SET o_orderstatus = 'T'; COMMIT")
    return Database(spark, db.store.path).execute(ALL)


def txn_rollback(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.script("BEGIN; DELETE FROM o; ROLLBACK")
    return db.execute("SELECT COUNT(*) AS n FROM o")


def txn_read_your_writes(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.script("BEGIN; DELETE FROM o WHERE o_orderkey > 10")
    return db.execute(ALL)


def recover_replay(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.execute("DELETE FROM o WHERE o_orderkey > 50")
    store = db.store
    out = store.fs.create(store._manifest(store.current().version + 1), False)  # a commit that a crash cut off
    out.write(bytearray(b"0000\n{"))
    out.close()
    return Database(spark, store.path).execute(ALL)


def compact_roundtrip(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.script("DELETE FROM o WHERE o_orderkey > 40; INSERT INTO o VALUES (1000001, 1, 2.5, 'N'); INSERT INTO o (o_orderkey) VALUES (1000002)")
    db.compact()
    return Database(spark, db.store.path).execute(ALL)


def index_lookup(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.execute("CREATE INDEX by_customer ON o(o_custkey)")
    return db.execute("SELECT o_orderkey FROM o WHERE o_custkey = 7")


def index_range(spark, sf_dir):
    db = orders(spark, sf_dir)
    db.execute("CREATE INDEX by_customer ON o(o_custkey)")
    return db.execute("SELECT o_orderkey, o_custkey FROM o WHERE o_custkey > 20 AND o_custkey <= 60")


def stats_nulls_minmax(spark, sf_dir):
    stats = database(spark, sf_dir).analyze("customer")["customer"]
    rows = [(c, float(s.null_frac), s.low, s.high) for c, s in stats.columns.items()]
    return spark.createDataFrame(rows, "name string, null_frac double, low double, high double")


def stats_ndv(spark, sf_dir):
    """Estimates; the exact number is within the sketch's error."""
    stats = database(spark, sf_dir).analyze("orders")["orders"]
    exact = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(*[F.count_distinct(c).alias(c) for c in stats.columns]).first()
    return spark.createDataFrame([(c, bool(abs(s.ndv - exact[c]) <= 0.06 * exact[c] + 1)) for c, s in stats.columns.items()], "name string, near boolean")


def q_error(spark, sf_dir):
    db = database(spark, sf_dir)
    where = ["o_custkey < 100", "o_totalprice > 200000", "o_orderstatus = 'F'", "o_orderstatus = 'F' AND o_custkey > 500", "NOT o_custkey < 100 OR o_totalprice < 1000", "o_custkey IN (1, 2, 3)"]
    rows = [(w, int(db.q_error(f"SELECT o_orderkey FROM orders WHERE {w}")[1])) for w in where]
    return spark.createDataFrame(rows, "predicate string, actual long")


def join_order(spark, sf_dir):
    order = database(spark, sf_dir).join_order("SELECT l.l_orderkey FROM lineitem l, orders o, customer c, nation n WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey")
    return spark.createDataFrame([(i, a) for i, a in enumerate(order)], "place int, alias string")


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as versions: who made and who ended each, by keys alone."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    versions = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), (F.col("o_orderkey") % 50 + 1).alias("xmin"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") * 7) % 50 + 1).otherwise(0).alias("xmax"))
    status = spark.range(1, 51).select(F.col("id").alias("txn"), F.when(F.col("id") % 7 == 0, "A").when(F.col("id") % 11 == 0, "I").otherwise("C").alias("st"))
    return versions, status


VERSIONS_SQL = "v AS (SELECT o_custkey AS key, o_orderkey AS value, o_orderkey % 50 + 1 AS xmin, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 7) % 50 + 1 ELSE 0 END AS xmax FROM orders), s AS (SELECT range AS txn, CASE WHEN range % 7 = 0 THEN 'A' WHEN range % 11 = 0 THEN 'I' ELSE 'C' END AS st FROM range(1, 51))"


def mvcc_visible(spark, sf_dir):
    return mvcc.visible(*_versions(spark, sf_dir), me=30, snapshot=40, in_flight=[25, 30])


def mvcc_vacuum(spark, sf_dir):
    return mvcc.vacuum(*_versions(spark, sf_dir), "key")


def ssi_pivot(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    edges = o.select((F.col("o_orderkey") % 50 + 1).alias("reader"), (F.col("o_custkey") % 50 + 1).alias("writer")).where("reader <> writer")
    return mvcc.pivots(edges, _versions(spark, sf_dir)[1])


def check_orphans(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return checks.orphans(read("orders"), "o_custkey", read("customer").where("c_custkey % 10 <> 3"), "c_custkey").select("o_orderkey", "o_custkey")


def check_double_ref(spark, sf_dir):
    return checks.duplicates(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_linenumber")


def check_report(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return checks.report({"no name": checks.nulls(c, "c_name"), "long name": checks.too_long(c, "c_name", 17), "balance": checks.outside(c, "c_acctbal", 0, 9000)})


O = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"
OTHERS: dict[str, tuple[Callable, str | None]] = {
    "insert_values": (insert_values, "SELECT * FROM (VALUES (1::BIGINT, -1294967296::INT, 2.0::DOUBLE, true, 'a;b'), (2, NULL, 1.5, NULL, ''), (2, -1, -0.5, false, 'it''s')) t(id, n, d, ok, s)"),
    "insert_partial_cols": (insert_partial_cols, "SELECT * FROM (VALUES (2::BIGINT, NULL::INT, 'x'), (NULL, 7, NULL)) t(id, n, s)"),
    "update_where": (update_where, "SELECT o_orderkey, CASE WHEN p THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_totalprice, CASE WHEN p THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM (SELECT *, o_totalprice > 200000 AND o_custkey <> 10 AS p FROM orders)"),
    "update_all": (update_all, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey END AS o_custkey, o_totalprice, o_orderstatus FROM orders"),
    "delete_where": (delete_where, f"{O} WHERE NOT (o_orderstatus = 'O' OR o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))"),
    "delete_all": (delete_all, "SELECT 0::BIGINT AS n"),
    "drop_create": (drop_create, "SELECT 1::INT AS a"),
    "txn_commit": (txn_commit, "SELECT o_orderkey, o_custkey, o_totalprice, 'T' AS o_orderstatus FROM orders WHERE o_orderkey <= 100"),
    "txn_rollback": (txn_rollback, "SELECT COUNT(*) AS n FROM orders"),
    "txn_read_your_writes": (txn_read_your_writes, f"{O} WHERE o_orderkey <= 10"),
    "recover_replay": (recover_replay, f"{O} WHERE o_orderkey <= 50"),
    "compact_roundtrip": (compact_roundtrip, f"{O} WHERE o_orderkey <= 40 UNION ALL VALUES (1000001, 1, 2.5, 'N'), (1000002, NULL, NULL, NULL)"),
    "index_lookup": (index_lookup, "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "index_range": (index_range, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 20 AND o_custkey <= 60"),
    "stats_nulls_minmax": (
        stats_nulls_minmax,
        " UNION ALL ".join(f"SELECT '{c}' AS name, 0.0::DOUBLE AS null_frac, {f'MIN({c})::DOUBLE' if n else 'NULL::DOUBLE'} AS low, {f'MAX({c})::DOUBLE' if n else 'NULL::DOUBLE'} AS high{' FROM customer' if n else ''}" for c, n in (("c_custkey", 1), ("c_name", 0), ("c_nationkey", 1), ("c_acctbal", 1), ("c_mktsegment", 0))),
    ),
    "stats_ndv": (stats_ndv, " UNION ALL ".join(f"SELECT '{c}' AS name, true AS near" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))),
    "q_error": (
        q_error,
        " UNION ALL ".join(
            "SELECT '{}' AS predicate, COUNT(*) AS actual FROM orders WHERE {}".format(w.replace("'", "''"), w)
            for w in ["o_custkey < 100", "o_totalprice > 200000", "o_orderstatus = 'F'", "o_orderstatus = 'F' AND o_custkey > 500", "NOT o_custkey < 100 OR o_totalprice < 1000", "o_custkey IN (1, 2, 3)"]
        ),
    ),
    "join_order": (join_order, "SELECT * FROM (VALUES (0, 'n'), (1, 'c'), (2, 'o'), (3, 'l')) t(place, alias)"),
    "mvcc_visible": (mvcc_visible, f"WITH {VERSIONS_SQL} SELECT v.* FROM v LEFT JOIN s i ON i.txn = xmin LEFT JOIN s x ON x.txn = xmax WHERE (xmin = 30 OR (i.st = 'C' AND xmin < 40 AND xmin NOT IN (25, 30))) AND (xmax = 0 OR NOT (xmax = 30 OR (x.st = 'C' AND xmax < 40 AND xmax NOT IN (25, 30))))"),
    "mvcc_vacuum": (mvcc_vacuum, f"WITH {VERSIONS_SQL}, n AS (SELECT v.* FROM v JOIN s ON s.txn = xmin WHERE s.st = 'C' QUALIFY row_number() OVER (PARTITION BY key ORDER BY xmin DESC, key, value, xmax) = 1) SELECT n.* FROM n LEFT JOIN s ON s.txn = xmax WHERE NOT (xmax <> 0 AND coalesce(s.st, '') = 'C')"),
    "ssi_pivot": (ssi_pivot, f"WITH {VERSIONS_SQL}, e AS (SELECT o_orderkey % 50 + 1 AS reader, o_custkey % 50 + 1 AS writer FROM orders WHERE o_orderkey % 50 + 1 <> o_custkey % 50 + 1) SELECT DISTINCT a.writer AS txn FROM e a JOIN e b ON a.writer = b.reader JOIN s ON s.txn = b.writer WHERE s.st = 'C'"),
    "check_orphans": (check_orphans, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)"),
    "check_double_ref": (check_double_ref, "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1"),
    "check_report": (check_report, "SELECT 'no name' AS rule, COUNT(*) FILTER (c_name IS NULL) AS broken FROM customer UNION ALL SELECT 'long name', COUNT(*) FILTER (octet_length(c_name::BLOB) > 17) FROM customer UNION ALL SELECT 'balance', COUNT(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) FROM customer"),
}


def _rounded(name: str, sql: str) -> str:
    if name not in ROUNDED:
        return sql
    return "SELECT * REPLACE (" + ", ".join(f"round({c}, {d}) AS {c}" for c, d in ROUNDED[name].items()) + f") FROM ({sql})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _select(n, s if isinstance(s, str) else s[0]) for n, s in SELECTS.items()} | {n: f for n, (f, _) in OTHERS.items()}
ORACLE_SQL: dict[str, str] = {n: _rounded(n, s if isinstance(s, str) else s[1]) for n, s in SELECTS.items()} | {n: s for n, (_, s) in OTHERS.items() if s}

__all__ = ["ORACLE_SQL", "QUERIES", "Store", "database"]
