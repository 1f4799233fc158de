"""Bind a SELECT to one lazy DataFrame; all rules on names, types and nulls that differ from Spark's own are here."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.errors import BindError
from quernel.functions import arithmetic as A
from quernel.operators import theta
from quernel.plans import ast

NUMERIC = {"int", "bigint", "double"}
#: Comparisons, and the same with their sides exchanged.
FLIPPED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
SPARK = {"int": "int", "bigint": "bigint", "double": "double", "bool": "boolean", "varchar": "string", "null": "void"}


def kind_of(data_type: T.DataType) -> str:
    """Types that the dialect doesn't have are carried through under their Spark name."""
    kinds = {T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.LongType: "bigint", T.DoubleType: "double", T.FloatType: "double", T.BooleanType: "bool", T.StringType: "varchar", T.VarcharType: "varchar", T.CharType: "varchar", T.NullType: "null"}
    return kinds.get(type(data_type), data_type.simpleString())


def common(kinds: list[str]) -> str:
    """The one type of alternatives."""
    known = {k for k in kinds if k != "null"}
    if len(known) <= 1:
        return known.pop() if known else "null"
    if known <= NUMERIC:
        return "double" if "double" in known else "bigint"
    raise BindError(f"no common type of {', '.join(sorted(known))}")


def comparable(a: str, b: str) -> bool:
    return "null" in (a, b) or a == b or {a, b} <= NUMERIC


@dataclass
class Bound:
    column: Column
    kind: str
    bounds: tuple[int, int] | None = None  # of integers

    def range(self) -> tuple[int, int]:
        return self.bounds or (A.INT if self.kind == "int" else A.BIGINT)

    def to(self, kind: str) -> Column:
        return self.column if kind in (self.kind, "null") else self.column.cast(SPARK.get(kind, kind))


@dataclass
class Field:
    table: str
    name: str
    internal: str
    kind: str


@dataclass
class Env:
    """The rows that expressions see. known: what aggregates and group keys have become, in a grouped query."""

    df: DataFrame
    fields: list[Field] = field(default_factory=list)
    known: dict | None = None


@dataclass
class Output:
    df: DataFrame  # columns o0, o1, ...
    names: list[str]
    kinds: list[str]

    def named(self) -> DataFrame:
        return self.df.toDF(*self.names)


def conjuncts(node) -> list:
    if isinstance(node, ast.Binary) and node.op == "and":
        return conjuncts(node.left) + conjuncts(node.right)
    return [] if node is None else [node]


class Binder:
    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame]):
        self.spark, self.table, self.counter = spark, table, itertools.count()

    def fresh(self, letter: str) -> str:
        return f"_{letter}{next(self.counter)}"

    # FROM
    def sources(self, sources: tuple, where=None) -> Env:
        if not sources:
            return Env(self.spark.range(1).select())
        env = None
        for s in sources:
            df = self.table(s.table)
            new = [Field(s.alias, f.name.lower(), self.fresh("c"), kind_of(f.dataType)) for f in df.schema]
            df = df.select(*[F.col(f"`{f.name}`").alias(n.internal) for f, n in zip(df.schema, new, strict=True)])
            if env is None:
                env = Env(df, new)
                continue
            both = Env(env.df, env.fields + new)
            on = F.lit(True) if s.on is None else self.condition(s.on, both, "ON")
            if both.df is not env.df:
                raise BindError("a subquery in ON isn't supported")
            dealt = self.dealt(s, where, both, {f.internal for f in new}, df) if s.kind == "inner" else None
            env = Env(env.df.join(df, on, s.kind) if dealt is None else dealt, both.fields)
        return env

    def dealt(self, s: ast.Source, where, both: Env, new: set[str], df: DataFrame) -> DataFrame | None:
        """The join by theta.join, if the tables meet by equal keys and by another condition too, and it is worth it."""
        if both.df.isStreaming or df.isStreaming:
            return None
        keys, order, rest, across = [], None, [], False
        ons = conjuncts(s.on)
        for i, part in enumerate(ons + conjuncts(where)):
            try:
                sides = self.sides(part, both, new)
                across |= sides is None and self.of(part, both, new) == {True, False}
            except BindError:  # of WHERE: it names later tables
                continue
            if sides and sides[0] == "=":
                a, b = sides[1:]
                if {a.kind, b.kind} <= NUMERIC or a.kind == b.kind in ("varchar", "bool", "date"):
                    kind = common([a.kind, b.kind])
                    keys.append((a.to(kind), b.to(kind)))
                    continue
            if sides:
                across = True
                if order is None and sides[0] != "=" and {sides[1].kind, sides[2].kind} <= NUMERIC:
                    order = (sides[0], sides[1].to("double"), sides[2].to("double"))
            if i < len(ons):
                rest.append(self.condition(part, both, "ON"))
        return theta.join(both.df, df, keys, order, rest) if keys and across else None

    def of(self, node, both: Env, new: set[str]) -> set[bool]:
        """Whether the columns of an expression are the new table's."""
        return {self.resolve(n, both).internal in new for n in ast.walk(node) if isinstance(n, ast.Name)}

    def sides(self, node, both: Env, new: set[str]) -> tuple[str, Bound, Bound] | None:
        """A comparison of an expression over the former tables with one over the new one, if neither can fail."""
        if not isinstance(node, ast.Binary) or node.op not in FLIPPED:
            return None
        if any(isinstance(n, (ast.Scalar, ast.InQuery, ast.Aggregate)) or isinstance(n, ast.Binary) and n.op == "/" for n in ast.walk(node)):
            return None
        of = self.of(node.left, both, new), self.of(node.right, both, new)
        if of == ({False}, {True}):
            return node.op, self.bind(node.left, both), self.bind(node.right, both)
        return (FLIPPED[node.op], self.bind(node.right, both), self.bind(node.left, both)) if of == ({True}, {False}) else None

    def resolve(self, name: ast.Name, env: Env) -> Field:
        found = [f for f in env.fields if f.name == name.column and name.table in (None, f.table)]
        if not found:
            raise BindError(f"unknown column {name.table + '.' if name.table else ''}{name.column}")
        if len(found) > 1:
            raise BindError(f"ambiguous column {name.column}")
        return found[0]

    # expressions
    def condition(self, node, env: Env, place: str) -> Column:
        b = self.bind(node, env)
        if b.kind not in ("bool", "null"):
            raise BindError(f"{place} must be a condition, not {b.kind}")
        return b.to("bool") if b.kind == "bool" else b.column.cast("boolean")

    def bind(self, node, env: Env) -> Bound:
        if env.known is not None and self.key(node, env) in env.known:
            return env.known[self.key(node, env)]
        return getattr(self, "e_" + type(node).__name__.lower())(node, env)

    def key(self, node, env: Env):
        """A form of an expression in which equal columns are equal, however they are qualified."""
        if isinstance(node, ast.Name):
            return ("column", self.resolve(node, env).internal)
        if isinstance(node, (ast.Literal, ast.Star)):
            return (type(node).__name__, type(getattr(node, "value", None)).__name__, node)
        if isinstance(node, (ast.Scalar,)):
            return node
        rest = tuple(str(getattr(node, a)) for a in ("op", "negated", "name", "distinct", "query") if hasattr(node, a))
        shape = (isinstance(node, ast.Case) and (node.of is None, node.otherwise is None)) or ()
        return (type(node).__name__, rest, shape, tuple(self.key(x, env) for x in ast.parts(node)))

    def e_literal(self, node, env):
        v = node.value
        if v is None:
            return Bound(F.lit(None), "null")
        if isinstance(v, bool):
            return Bound(F.lit(v), "bool")
        if isinstance(v, int):
            return Bound(F.lit(v).cast("bigint"), "bigint", (v, v))
        return Bound(F.lit(v), "double") if isinstance(v, float) else Bound(F.lit(v), "varchar")

    def e_name(self, node, env):
        f = self.resolve(node, env)
        return Bound(F.col(f.internal), f.kind)

    def e_unary(self, node, env):
        if node.op == "not":
            return Bound(~self.condition(node.of, env, "NOT"), "bool")
        b = self.bind(node.of, env)
        if b.kind not in NUMERIC | {"null"}:
            raise BindError(f"{node.op} of {b.kind}")
        if node.op == "+" or b.kind in ("null",):
            return b
        if b.kind == "double":
            return Bound(-b.column, "double")
        low, high = A.interval("-", (0, 0), b.range())
        if b.kind == "int":
            return Bound(A.to_int(F.lit(0).cast("bigint") - b.column.cast("bigint")), "int")
        return Bound(A.exact("-", F.lit(0), b.column, high <= A.BIGINT[1]), "bigint", (low, high) if high <= A.BIGINT[1] else None)

    def e_binary(self, node, env):
        if node.op in ("and", "or"):
            a, b = self.condition(node.left, env, node.op.upper()), self.condition(node.right, env, node.op.upper())
            return Bound(a & b if node.op == "and" else a | b, "bool")
        a, b = self.bind(node.left, env), self.bind(node.right, env)
        if node.op in ("+", "-", "*", "/"):
            return self.arithmetic(node.op, a, b)
        return Bound(self.compare(node.op, a, b), "bool")

    def arithmetic(self, op: str, a: Bound, b: Bound) -> Bound:
        if not {a.kind, b.kind} <= NUMERIC | {"null"}:
            raise BindError(f"{a.kind} {op} {b.kind}")
        if "null" in (a.kind, b.kind):
            kind = "double" if op == "/" or "double" in (a.kind, b.kind) else "bigint"
            return Bound(F.lit(None).cast(kind), kind)
        if op == "/":
            return Bound(A.divide(a.column, b.column), "double")
        if "double" in (a.kind, b.kind):
            x, y = a.to("double"), b.to("double")
            return Bound({"+": x + y, "-": x - y, "*": x * y}[op], "double")
        bounds = A.interval(op, a.range(), b.range())
        fits = A.BIGINT[0] <= bounds[0] and bounds[1] <= A.BIGINT[1]
        return Bound(A.exact(op, a.column, b.column, fits), "bigint", bounds if fits else None)

    def compare(self, op: str, a: Bound, b: Bound) -> Column:
        if not comparable(a.kind, b.kind):
            raise BindError(f"{a.kind} {op} {b.kind}")
        if "null" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        x, y = a.column, b.column
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def e_isnull(self, node, env):
        c = self.bind(node.of, env).column
        return Bound(c.isNotNull() if node.negated else c.isNull(), "bool")

    def e_inlist(self, node, env):
        of, items = self.bind(node.of, env), [self.bind(x, env) for x in node.items]
        fit = [x for x in items if comparable(of.kind, x.kind)]  # others never match
        if of.kind == "null":
            found = F.lit(None).cast("boolean")
        else:
            found = reduce(lambda a, b: a | b, [self.compare("=", of, x) for x in fit], F.when(of.column.isNull(), F.lit(None)).otherwise(False).cast("boolean"))
        return Bound(~found if node.negated else found, "bool")

    def subquery(self, query: ast.Select) -> tuple[DataFrame, str]:
        out = Binder.select(Binder(self.spark, self.table), query)
        return out.df.select(F.col("o0").alias(name := self.fresh("q"))), out.kinds[0], name

    def e_inquery(self, node, env):
        """A mark join: whether a match was found, then what nulls there are decide."""
        of = self.bind(node.of, env)
        sub, kind, name = self.subquery(node.query)
        if not comparable(of.kind, kind):
            raise BindError(f"{of.kind} IN a subquery of {kind}")
        if "null" in (of.kind, kind):
            of, sub = Bound(of.column.cast("string"), "varchar"), sub.select(F.col(name).cast("string").alias(name))
        probe, mark, rows, nulls = (self.fresh("m") for _ in range(4))
        facts = sub.agg(F.count("*").alias(rows), F.count(F.when(F.col(name).isNull(), 1)).alias(nulls))
        marks = sub.where(F.col(name).isNotNull()).distinct().withColumn(mark, F.lit(True))
        env.df = env.df.withColumn(probe, of.column).join(marks, F.col(probe) == F.col(name), "left").join(F.broadcast(facts), F.lit(True))
        found = F.when(F.col(rows) == 0, F.lit(False)).when(F.col(mark), True).when(F.col(probe).isNull() | (F.col(nulls) > 0), F.lit(None).cast("boolean")).otherwise(False)
        return Bound(~found if node.negated else found, "bool")

    def e_scalar(self, node, env):
        sub, kind, _ = self.subquery(node.query)
        return Bound(sub.scalar(), kind)

    def e_case(self, node, env):
        if not node.whens:
            return self.bind(node.otherwise or ast.Literal(None), env)
        of = None if node.of is None else self.bind(node.of, env)
        whens = [(self.condition(w, env, "WHEN") if of is None else self.compare("=", of, self.bind(w, env)), self.bind(t, env)) for w, t in node.whens]
        last = self.bind(node.otherwise or ast.Literal(None), env)
        kind = common([t.kind for _, t in whens] + [last.kind])
        out = F
        for w, t in whens:
            out = out.when(w, t.to(kind))
        return Bound(out.otherwise(last.to(kind)), kind)

    def e_aggregate(self, node, env):
        raise BindError(f"{node.name.upper()} is not allowed here")

    def e_star(self, node, env):
        raise BindError("* is not an expression")

    # SELECT
    def expand(self, items: tuple, env: Env) -> list[tuple[object, str]]:
        """Expressions and output names."""
        out = []
        for i in items:
            if isinstance(i.expr, ast.Star):
                found = [f for f in env.fields if i.expr.table in (None, f.table)]
                if not found:
                    raise BindError(f"nothing to expand in {i.expr.table or ''}*")
                out += [(ast.Name(f.name, f.table), f.name) for f in found]
            else:
                e = i.expr
                out.append((e, i.alias or (e.column if isinstance(e, ast.Name) else e.name if isinstance(e, ast.Aggregate) else "?column?")))
        return out

    def where(self, node, env: Env) -> None:
        for part in conjuncts(node):
            if isinstance(part, ast.InQuery) and not part.negated:
                of = self.bind(part.of, env)
                sub, kind, name = self.subquery(part.query)
                if comparable(of.kind, kind) and "null" not in (of.kind, kind):
                    env.df = env.df.join(sub, of.column == F.col(name), "left_semi")
                    continue
            chosen = self.condition(part, env, "WHERE")  # may join a subquery to env.df
            env.df = env.df.where(chosen)

    def grouped(self, q: ast.Select, exprs: list, env: Env) -> Env:
        """The environment of groups: aggregates, group keys and, for other columns, the first row's values are known."""
        keys, known, inputs, aggs = [], {}, {}, []
        for g in q.group:
            b = self.bind(g, env)
            inputs[name := self.fresh("g")] = b.column
            keys.append(name)
            known.setdefault(self.key(g, env), Bound(F.col(name), b.kind, b.bounds))
        for e in exprs:
            for n in self.outside(e):
                k = self.key(n, env)
                if k in known:
                    continue
                name = self.fresh("a")
                if isinstance(n, ast.Name):
                    f = self.resolve(n, env)
                    aggs.append(F.first(f.internal).alias(name))
                    known[k] = Bound(F.col(name), f.kind)
                    continue
                if n.of is None:
                    if n.name != "count":
                        raise BindError(f"{n.name.upper()}(*)")
                    aggs.append(F.count("*").alias(name))
                    known[k] = Bound(F.col(name), "bigint", (0, A.BIGINT[1]))
                    continue
                b = self.bind(n.of, env)
                inputs[source := self.fresh("i")] = b.column
                agg, kind = self.aggregate(n, b, F.col(source))
                aggs.append(agg.alias(name))
                known[k] = Bound(F.col(name), kind)
        df = env.df.withColumns(inputs) if inputs else env.df
        aggs = aggs or [F.count("*").alias(self.fresh("a"))]
        return Env(df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs), env.fields, known)

    def outside(self, node):
        """Aggregates, and columns that aren't within one."""
        if isinstance(node, (ast.Aggregate, ast.Name)):
            yield node
        else:
            for x in ast.parts(node):
                yield from self.outside(x)

    def aggregate(self, n: ast.Aggregate, b: Bound, c: Column) -> tuple[Column, str]:
        if n.name == "count":
            return (F.count_distinct(c) if n.distinct else F.count(c)), "bigint"
        if n.name in ("min", "max"):
            return (F.min if n.name == "min" else F.max)(c), b.kind
        if b.kind not in NUMERIC | {"null"}:
            raise BindError(f"{n.name.upper()} of {b.kind}")
        if n.name == "avg":
            c = c.cast("double")
            return F.call_function("avg", c) if not n.distinct else F.sum_distinct(c) / F.when(F.count_distinct(c) > 0, F.count_distinct(c)), "double"
        if b.kind == "double":
            return (F.sum_distinct if n.distinct else F.sum)(c), "double"
        if n.distinct:
            return A.sum_distinct_bigint(c), "bigint"
        if b.kind == "int" or b.bounds and max(map(abs, b.bounds)) < 1 << 31:  # no overflow below 2**32 rows
            return F.sum(c.cast("bigint")), "bigint"
        return A.sum_bigint(c), "bigint"

    def select(self, q: ast.Select) -> Output:
        env = self.sources(q.sources, q.where)
        self.where(q.where, env)
        items = self.expand(q.items, env)
        names = [n for _, n in items]
        order = [self.sort_key(o, names) for o in q.order]
        exprs = [e for e, _ in items] + ([q.having] if q.having else []) + [o for o, _ in order if not isinstance(o, int)]
        if q.group or q.having is not None or any(isinstance(x, ast.Aggregate) for e in exprs for x in ast.walk(e)):
            env = self.grouped(q, exprs, env)
            if q.having is not None:
                chosen = self.condition(q.having, env, "HAVING")
                env.df = env.df.where(chosen)
        bound = [self.bind(e, env) for e, _ in items]
        hidden = {f"s{i}": self.bind(o, env).column for i, (o, _) in enumerate(order) if not isinstance(o, int)}
        outs = [f"o{i}" for i in range(len(bound))]
        df = env.df.select(*[b.column.alias(o) for b, o in zip(bound, outs, strict=True)], *[c.alias(k) for k, c in hidden.items()])
        if q.distinct:
            df = df.groupBy(*outs).agg(*[F.min(k).alias(k) for k in hidden]) if hidden else df.distinct()
        if order:
            at = [F.col(f"o{o}" if isinstance(o, int) else f"s{i}") for i, (o, _) in enumerate(order)]
            df = df.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_first() for c, (_, d) in zip(at, order, strict=True)])
        if q.limit is not None:
            df = df.limit(q.limit)
        return Output(df.select(*outs), names, [b.kind for b in bound])

    def sort_key(self, o: ast.Order, names: list[str]) -> tuple[object, bool]:
        """An output's place, or an expression over the rows."""
        if isinstance(o.expr, ast.Name) and o.expr.column in names:
            return names.index(o.expr.column), o.descending
        if isinstance(o.expr, ast.Literal) and isinstance(o.expr.value, int) and not isinstance(o.expr.value, bool):
            if not 1 <= o.expr.value <= len(names):
                raise BindError(f"ORDER BY position {o.expr.value} is not in the list")
            return o.expr.value - 1, o.descending
        return o.expr, o.descending
