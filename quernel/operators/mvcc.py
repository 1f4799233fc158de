"""Versions of rows: what a reader sees of them, and stores with snapshot and serializable isolation."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.errors import SerializationFailure, WriteConflict

COMMITTED, ABORTED, ACTIVE = "C", "A", "I"


def _done(txn: str, status: str, snapshot: int, in_flight: list[int]) -> Column:
    """Whether a transaction had committed when the snapshot was taken."""
    out = F.col(status).eqNullSafe(COMMITTED) & (F.col(txn) < snapshot)
    return out & ~F.col(txn).isin(in_flight) if in_flight else out


def visible(versions: DataFrame, status: DataFrame, me: int, snapshot: int, in_flight: list[int]) -> DataFrame:
    """The versions (xmin, xmax, 0: none, ...) that transaction me sees. status: txn and st."""
    names = versions.columns
    i = status.select(F.col("txn").alias("_i"), F.col("st").alias("_ist"))
    x = status.select(F.col("txn").alias("_x"), F.col("st").alias("_xst"))
    v = versions.join(i, F.col("xmin") == F.col("_i"), "left").join(x, F.col("xmax") == F.col("_x"), "left")
    made = (F.col("xmin") == me) | _done("xmin", "_ist", snapshot, in_flight)
    gone = (F.col("xmax") != 0) & ((F.col("xmax") == me) | _done("xmax", "_xst", snapshot, in_flight))
    return v.where(made & ~gone).select(*names)


def vacuum(versions: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Without active transactions: the newest committed version of each row, if it wasn't deleted since."""
    names = versions.columns
    i = status.select(F.col("txn").alias("_i"), F.col("st").alias("_ist"))
    x = status.select(F.col("txn").alias("_x"), F.col("st").alias("_xst"))
    live = versions.join(i, F.col("xmin") == F.col("_i")).where(F.col("_ist") == COMMITTED).join(x, F.col("xmax") == F.col("_x"), "left")
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("xmin"), *names))
    return live.withColumn("_n", newest).where((F.col("_n") == 1) & ~((F.col("xmax") != 0) & F.col("_xst").eqNullSafe(COMMITTED))).select(*names)


def pivots(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Transactions with a read-write dependency in and one out to a committed transaction. edges: reader, writer."""
    done = status.where(F.col("st") == COMMITTED).select(F.col("txn").alias("writer"))
    out = edges.join(done, "writer", "left_semi").select(F.col("reader").alias("txn"))
    return edges.select(F.col("writer").alias("txn")).join(out, "txn", "left_semi").distinct()


@dataclass
class Version:
    value: object
    xmin: int
    xmax: int = 0


@dataclass
class Txn:
    id: int
    in_flight: frozenset
    reads: set = field(default_factory=set)
    writes: set = field(default_factory=set)
    conflict_in: bool = False
    conflict_out: set = field(default_factory=set)


class MvccStore:
    """Rows by key under snapshot isolation; of two writers of a row, the first to update wins."""

    def __init__(self):
        self.rows: dict[object, list[Version]] = {}
        self.status: dict[int, str] = {}
        self.active: dict[int, Txn] = {}
        self.ids = itertools.count(1)

    def begin(self) -> Txn:
        t = Txn(next(self.ids), frozenset(self.active))
        self.active[t.id], self.status[t.id] = t, ACTIVE
        return t

    def _before(self, x: int, t: Txn) -> bool:
        return x == t.id or (self.status.get(x) == COMMITTED and x < t.id and x not in t.in_flight)

    def _sees(self, v: Version, t: Txn) -> bool:
        return self._before(v.xmin, t) and not (v.xmax and self._before(v.xmax, t))

    def read(self, t: Txn, key):
        return next((v.value for v in reversed(self.rows.get(key, [])) if self._sees(v, t)), None)

    def update(self, t: Txn, key, value) -> None:
        """Write a row; None deletes it."""
        chain = self.rows.setdefault(key, [])
        newest = next((v for v in reversed(chain) if self.status[v.xmin] != ABORTED), None)
        if newest is not None:
            taken = newest.xmax and self.status[newest.xmax] != ABORTED and newest.xmax != t.id
            if not self._before(newest.xmin, t) or taken:
                raise WriteConflict(f"row {key!r} was changed by another transaction")
            newest.xmax = t.id
        if value is not None:
            chain.append(Version(value, t.id))
        t.writes.add(key)

    def commit(self, t: Txn) -> None:
        self.status[t.id] = COMMITTED
        del self.active[t.id]

    def abort(self, t: Txn) -> None:
        self.status[t.id] = ABORTED
        del self.active[t.id]

    def vacuum(self) -> int:
        """Drop versions of aborted transactions, and ended ones that no active transaction can see."""
        n = 0
        for key, chain in self.rows.items():
            ended = lambda v: v.xmax and self.status[v.xmax] == COMMITTED and not self.active
            kept = [v for v in chain if self.status[v.xmin] != ABORTED and not ended(v)]
            n += len(chain) - len(kept)
            self.rows[key] = kept
        return n


class SsiStore(MvccStore):
    """Serializable: a transaction between two read-write dependencies, of which the outer has committed, fails."""

    def __init__(self):
        super().__init__()
        self.done: list[Txn] = []

    def _concurrent(self, t: Txn) -> list[Txn]:
        return [o for o in [*self.active.values(), *self.done] if o.id != t.id and (o.id in t.in_flight or t.id in o.in_flight)]

    def read(self, t: Txn, key):
        t.reads.add(key)
        for o in self._concurrent(t):
            if key in o.writes:
                t.conflict_out.add(o.id)
                o.conflict_in = True
        return super().read(t, key)

    def update(self, t: Txn, key, value) -> None:
        super().update(t, key, value)
        for o in self._concurrent(t):
            if key in o.reads:
                o.conflict_out.add(t.id)
                t.conflict_in = True

    def commit(self, t: Txn) -> None:
        # t itself may be the pivot, or make one of a concurrent reader that is one already
        pivot = t.conflict_in and any(self.status[x] == COMMITTED for x in t.conflict_out)
        makes = any(o.conflict_in and t.id in o.conflict_out and self.status[o.id] == COMMITTED for o in self.done)
        if pivot or makes:
            self.abort(t)
            raise SerializationFailure(f"transaction {t.id} fits no serial order")
        super().commit(t)
        self.done.append(t)
        oldest = min(self.active, default=None)
        self.done = [o for o in self.done if oldest is not None and any(o.id in a.in_flight or a.id in o.in_flight for a in self.active.values())]
