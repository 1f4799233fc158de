"""A database: SQL over snapshot tables and registered Parquet tables, with transactions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.errors import BindError, CatalogError, ConstraintError, TxnError
from quernel.functions import arithmetic as A
from quernel.operators import stats as S
from quernel.plans import ast
from quernel.plans.binder import Binder, Bound, Env, Field, kind_of
from quernel.plans.parser import parse, split_script
from quernel.sources.snapshots import State, Store, Table


#: Seconds for which compaction keeps what a lazy SELECT may still read.
RETAIN_SECONDS = 3600


class Transaction:
    """A base version, and the tables as this transaction has changed them."""

    def __init__(self, base: State, marker: str, serializable: bool = False):
        self.base, self.state, self.marker, self.serializable = base, base.copy(), marker, serializable
        self.changed: set[str] = set()
        self.seen: set[str] = set()


class Database:
    """Tables under path, if one is given, and views of Parquet files.

    Each statement outside BEGIN and COMMIT is a transaction of its own. A SELECT is a lazy DataFrame over the
    snapshot it was made on, or over what its own transaction has written.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, serializable: bool = False):
        self.spark, self.serializable = spark, serializable
        self.store = Store(spark, path) if path else None
        self.views: dict[str, Callable[[], DataFrame]] = {}
        self.txn: Transaction | None = None
        self.stats: dict[str, S.TableStats] = {}

    # tables
    def register_parquet(self, folder: str, *names: str) -> Database:
        """Tables over folder/NAME.parquet. Files are listed and their schema is read at the first use alone; register anew if they change."""
        for n in names:
            self.views[n] = cache(lambda n=n: self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def register(self, name: str, df: DataFrame) -> Database:
        self.views[name] = lambda: df
        return self

    def state(self) -> State:
        return self.txn.state if self.txn else self.store.current() if self.store else State(0, {})

    def table(self, name: str) -> DataFrame:
        if found := self.state().tables.get(name):
            if self.txn:
                self.txn.seen.add(name)
            return self.store.read(found)
        if name in self.views:
            return self.views[name]()
        raise BindError(f"unknown table {name}")

    def load(self, name: str, df: DataFrame) -> Database:
        """Make a stored table of a DataFrame, whose types must be the dialect's."""
        kinds = [kind_of(f.dataType) for f in df.schema]
        if odd := [k for k in kinds if k not in ("int", "bigint", "double", "bool", "varchar")]:
            raise CatalogError(f"columns of type {', '.join(sorted(set(odd)))} can't be stored")
        alone = self.txn is None
        if alone:
            self.begin()
        columns = tuple(ast.ColumnDef(f.name.lower(), k, 65535 if k == "varchar" else None, False) for f, k in zip(df.schema, kinds, strict=True))
        try:
            self._createtable(ast.CreateTable(name, columns))
            self._put(name, df.toDF(*[c.name for c in columns]), False)
        except BaseException:
            if alone:
                self.rollback()
            raise
        if alone:
            self.commit()
        return self

    def _own(self, name: str) -> Table:
        if found := self.txn.state.tables.get(name):
            return found
        raise (CatalogError(f"table {name} can't be changed") if name in self.views else BindError(f"unknown table {name}"))

    # statements
    def execute(self, sql: str) -> DataFrame | None:
        """Run one statement; a SELECT gives a DataFrame."""
        stmt = parse(sql)
        if isinstance(stmt, ast.Select):
            return Binder(self.spark, self.table).select(stmt).named()
        if isinstance(stmt, ast.Txn):
            return getattr(self, stmt.what)()
        if self.store is None:
            raise CatalogError("this database has no path to write to")
        alone = self.txn is None
        if alone:
            self.begin()
        mark = self.txn.state.copy()
        try:
            getattr(self, "_" + type(stmt).__name__.lower())(stmt)
        except BaseException:
            self.txn.state = mark  # a failing statement changes nothing
            if alone:
                self.rollback()
            raise
        if alone:
            self.commit()
        return None

    def script(self, sql: str) -> list[DataFrame]:
        return [out for s in split_script(sql) if (out := self.execute(s)) is not None]

    def begin(self) -> None:
        if self.txn:
            raise TxnError("there is a transaction already")
        if self.store is None:
            raise CatalogError("this database has no path to write to")
        self.txn = Transaction(*self.store.enter(), self.serializable)

    def commit(self) -> None:
        txn, self.txn = self.txn, None
        if txn is None:
            return
        try:
            if txn.changed:
                self.store.publish(txn.state, txn.base, txn.changed, txn.seen if txn.serializable else set())
        finally:
            self.store.leave(txn.marker)

    def rollback(self) -> None:
        txn, self.txn = self.txn, None
        if txn:
            self.store.leave(txn.marker)

    def _createtable(self, s: ast.CreateTable) -> None:
        if s.name in self.txn.state.tables or s.name in self.views:
            raise CatalogError(f"table {s.name} exists")
        names = [c.name for c in s.columns]
        if len(set(names)) < len(names):
            raise CatalogError(f"table {s.name} names a column twice")
        self.txn.state.tables[s.name] = Table([{"name": c.name, "kind": c.kind, "size": c.size, "not_null": c.not_null} for c in s.columns])
        self.txn.changed.add(s.name)

    def _createindex(self, s: ast.CreateIndex) -> None:
        """Files hold ranges of the first index's column and are in its order, then in that of other indexes: scans skip files and row groups by their bounds."""
        t = self._own(s.table)
        if len(s.columns) != 1:
            raise CatalogError("an index has one column")
        if s.columns[0] not in [c["name"] for c in t.columns]:
            raise BindError(f"unknown column {s.columns[0]}")
        if any(s.name in x.indexes for x in self.txn.state.tables.values()):
            raise CatalogError(f"index {s.name} exists")
        t.indexes[s.name] = s.columns[0]
        if t.folders:
            t.folders = [self._write(t, self.store.read(t))]
        self.txn.changed.add(s.table)

    def _drop(self, s: ast.Drop) -> None:
        if s.what == "table":
            if s.name not in self.txn.state.tables:
                raise CatalogError(f"unknown table {s.name}")
            del self.txn.state.tables[s.name]
            self.txn.changed.add(s.name)
            self.stats.pop(s.name, None)
            return
        for name, t in self.txn.state.tables.items():
            if s.name in t.indexes:
                del t.indexes[s.name]
                self.txn.changed.add(name)
                return
        raise CatalogError(f"unknown index {s.name}")

    def _write(self, t: Table, df: DataFrame) -> str:
        if t.indexes:
            columns = list(dict.fromkeys(t.indexes.values()))
            df = df.repartitionByRange(columns[0]).sortWithinPartitions(*columns)
        return self.store.write(df, self.txn.marker)

    def _stored(self, b: Bound, kind: str) -> Column:
        """A value as a column of kind keeps it."""
        if b.kind == kind:
            return b.column
        if b.kind == "null":
            return F.lit(None).cast(T.StringType() if kind == "varchar" else {"bool": "boolean"}.get(kind, kind))
        if (b.kind, kind) == ("bigint", "int"):
            return A.to_int(b.column)
        if (b.kind, kind) in {("int", "bigint"), ("int", "double"), ("bigint", "double")}:
            return b.column.cast(kind)
        raise BindError(f"a value of type {b.kind} can't be stored in a column of type {kind}")

    def _checked(self, t: Table, df: DataFrame) -> DataFrame:
        """df with values that fail on a null or a long text where none may be, as it is written."""
        out = []
        for c in t.defs():
            x = F.col(c.name)
            if c.not_null:
                x = F.when(x.isNull(), F.raise_error(F.lit(f"CONSTRAINT: null in column {c.name}")).cast(t.schema()[c.name].dataType)).otherwise(x)
            if c.kind == "varchar" and c.size is not None:
                x = F.when(F.octet_length(F.col(c.name)) > c.size, F.raise_error(F.lit(f"CONSTRAINT: text too long for column {c.name}")).cast("string")).otherwise(x)
            out.append(x.alias(c.name))
        return df.select(*out)

    def _put(self, name: str, df: DataFrame, append: bool) -> None:
        t = self._own(name)
        try:
            folder = self._write(t, self._checked(t, df))
        except Exception as e:
            if "CONSTRAINT: " in str(e):
                raise ConstraintError(str(e).split("CONSTRAINT: ")[1].split("\n")[0]) from e
            raise
        t.folders = [*t.folders, folder] if append else [folder]
        self.txn.changed.add(name)

    def _insert(self, s: ast.Insert) -> None:
        t = self._own(s.table)
        defs = t.defs()
        names = list(s.columns or [c.name for c in defs])
        if unknown := set(names) - {c.name for c in defs}:
            raise BindError(f"unknown column {min(unknown)}")
        if any(len(r) != len(names) for r in s.rows) or len(set(names)) < len(names):
            raise BindError("the number of values isn't that of the columns")
        binder, env = Binder(self.spark, self.table), Env(self.spark.range(1).select())
        rows = []
        for r in s.rows:
            given = dict(zip(names, r, strict=True))
            rows.append(F.struct(*[self._stored(binder.bind(given.get(c.name, ast.Literal(None)), env), c.kind).alias(c.name) for c in defs]))
        df = env.df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        self._put(s.table, df, True)

    def _env(self, name: str) -> Env:
        df = self.table(name)
        return Env(df, [Field(name, f.name.lower(), f.name, kind_of(f.dataType)) for f in df.schema])

    def _chosen(self, where, binder: Binder, env: Env) -> Column:
        return F.lit(True) if where is None else F.coalesce(binder.condition(where, env, "WHERE"), F.lit(False))

    def _delete(self, s: ast.Delete) -> None:
        t = self._own(s.table)
        if s.where is None:
            t.folders = []
            self.txn.changed.add(s.table)
            return
        binder, env = Binder(self.spark, self.table), self._env(s.table)
        chosen = self._chosen(s.where, binder, env)
        self._put(s.table, env.df.where(~chosen).select(*[c["name"] for c in t.columns]), False)

    def _update(self, s: ast.Update) -> None:
        t = self._own(s.table)
        binder, env = Binder(self.spark, self.table), self._env(s.table)
        kinds = {c.name: c.kind for c in t.defs()}
        sets = {}
        for name, e in s.sets:
            if name not in kinds:
                raise BindError(f"unknown column {name}")
            sets[name] = self._stored(binder.bind(e, env), kinds[name])
        chosen = self._chosen(s.where, binder, env)
        # values are made for chosen rows alone, so an error in another row's is none
        out = [F.when(chosen, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in kinds]
        self._put(s.table, env.df.select(*out), False)

    # maintenance
    def compact(self, retain_seconds: float = RETAIN_SECONDS) -> int:
        """Each table in one folder; the number of folders deleted, of those that neither an open transaction nor a reader of the last retain_seconds may need."""
        if self.store is None or self.txn:
            raise TxnError("compaction needs a path, and no open transaction")
        self.begin()
        try:
            for name, t in self.txn.state.tables.items():
                if len(t.folders) > 1:
                    t.folders = [self._write(t, self.store.read(t))]
                    self.txn.changed.add(name)
        except BaseException:
            self.rollback()
            raise
        self.commit()
        return self.store.vacuum(retain_seconds)

    def dump_sql(self) -> str:
        """A script that makes the tables anew. Rows pass the driver one by one: for small tables."""
        spell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
        out = []
        for name, t in sorted(self.state().tables.items()):
            kinds = [f"{c.name} {c.kind.upper()}{f'({c.size})' if c.size is not None else ''}{' NOT NULL' * c.not_null}" for c in t.defs()]
            out.append(f"CREATE TABLE {name} ({', '.join(kinds)});")
            out += [f"INSERT INTO {name} VALUES ({', '.join(map(spell, r))});" for r in self.store.read(t).toLocalIterator()]
            out += [f"CREATE INDEX {i} ON {name}({c});" for i, c in t.indexes.items()]
        return "\n".join(out)

    def analyze(self, *names: str) -> dict[str, S.TableStats]:
        for n in names or [*self.state().tables, *self.views]:
            self.stats[n] = S.table_stats(self.table(n))
        return self.stats

    def q_error(self, sql: str) -> tuple[float, int, float]:
        """Estimated rows, actual rows and their q-error for a SELECT over one table."""
        q = parse(sql)
        if not isinstance(q, ast.Select) or len(q.sources) != 1:
            raise BindError("q_error takes a SELECT over one table")
        name = q.sources[0].table
        stats = self.stats.get(name) or self.analyze(name)[name]
        estimated = stats.rows * (S.selectivity(q.where, stats) if q.where is not None else 1.0)
        actual = self.execute(sql).count()
        return estimated, actual, S.q_error(estimated, actual)

    def access_path(self, sql: str, crossover: float = 0.2) -> str:
        """Whether an index's order is worth using for a SELECT over one table: index or scan."""
        q = parse(sql)
        t = self.state().tables.get(q.sources[0].table)
        usable = t and S.sargable(q.where, set(t.indexes.values()))
        if not usable:
            return "scan"
        stats = self.stats.get(q.sources[0].table)
        return "index" if stats is None or S.prefers_index(S.selectivity(usable, stats), crossover) else "scan"

    def join_order(self, sql: str) -> list[str] | None:
        """The aliases in the order of least intermediate rows, or None where the joins can't be reordered."""
        q = parse(sql)
        return S.join_order(q, self.table) if isinstance(q, ast.Select) else None
