"""Inner joins on equal keys and a further condition, where few keys have very many pairs of rows.

Such keys' pairs are dealt out to cells, a key's rows in a cell being compared by one task. The rows of the larger side
go to one cell each: that of the bin of the value that the condition orders, and within it by the hash of the row. Those
of the smaller go to all cells of the bins in which they may find a match, so that most other pairs are never made.
Bins and cells only decide where rows meet. They are counted when the query is bound; if the tables change before it
runs, the result is still right, as every value has a bin and bins follow the order of the values.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of rows with equal keys from which on joins are dealt out, if there are also so many a row.
WORTH, PER_ROW = 1 << 26, 16
#: Pairs of a cell, at most, unless it has but FEW rows of the larger side.
PAIRS, FEW = 1 << 24, 256
#: Keys of this share of all pairs, and of so many, have cells; the others are dealt out whole.
SHARE, HEAVY = 1 / 1000, 1 << 20
BINS = 32


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _bin(at: Column) -> Column:
    """0 below the window from _lo to _hi, BINS + 1 from its end on (and for NaN), never less for more."""
    return F.when(at < F.col("_lo"), 0).when(at >= F.col("_hi"), BINS + 1).otherwise(F.coalesce(F.width_bucket(at, F.col("_lo"), F.col("_hi"), F.lit(BINS)), F.lit(1))).cast("int")


def _window(low: float, high: float) -> tuple[float, float]:
    """The values between which matches are found, in order; a point if their distance has no use as a number."""
    low, high = min(low, high), max(low, high)
    return (low, high) if math.isfinite((high - low) * BINS * 2) else (high, high)


def _cells(big: list[int], small: list[int], up: bool) -> tuple[list[int], int]:
    """The first cell of each bin, then their number; and the pairs of all, given each bin's rows."""
    first, pairs = [0], 0
    for b, n in enumerate(big):
        met = n * sum(small[: b + 1] if up else small[b:])
        first.append(first[-1] + max(1, min(math.ceil(met / PAIRS), n // FEW)))
        pairs += met
    return first, pairs


def join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], order: tuple[str, Column, Column] | None, rest: list[Column]) -> DataFrame | None:
    """Rows of both with equal keys, on which rest holds; None if there are too few pairs to deal them out.

    order: a comparison (> >= < <=) of doubles of left and right that holds where rest does, but may hold for equal
    values too. Rows that are alike in all columns stay together.
    """
    op, *at = order or (">", F.lit(0.0), F.lit(0.0))
    names, sides = [f"_k{i}" for i in range(len(keys))], []
    for i, df in enumerate((left, right)):
        side = df.where(_all([k[i].isNotNull() for k in keys] + [at[i].isNotNull()]))
        sides.append((side, [k[i] for k in keys], at[i]))
    groups = [side.groupBy(*[k.alias(n) for k, n in zip(ks, names, strict=True)]).agg(F.count("*").alias(f"_n{i}"), F.min(x).alias(f"_min{i}"), F.max(x).alias(f"_max{i}")) for i, (side, ks, x) in enumerate(sides)]
    both = groups[0].join(groups[1], names).withColumn("_pairs", F.col("_n0").cast("double") * F.col("_n1"))
    total, *n = both.agg(F.sum("_pairs"), F.sum("_n0"), F.sum("_n1")).first()
    if total is None or total < max(WORTH, PER_ROW * sum(n)):
        return None

    heavy = both.where(F.col("_pairs") >= max(total * SHARE, HEAVY)).collect()
    b = 0 if n[0] >= n[1] else 1  # the larger side
    s, up = 1 - b, (op in (">", ">=")) == (b == 0)
    windows = [_window(*((r[f"_min{s}"], r[f"_max{b}"]) if up else (r[f"_min{b}"], r[f"_max{s}"]))) for r in heavy]
    rows = [(*[r[x] for x in names], *w) for r, w in zip(heavy, windows, strict=True)]
    fields = [both.schema[x] for x in names] + [T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())]

    def small_table(name: str, kind: T.DataType, values: list) -> DataFrame:
        """The heavy keys with their windows and a value each."""
        schema = T.StructType([*fields, T.StructField(name, kind)])
        columns = zip(*[(*r, v) for r, v in zip(rows, values, strict=True)], strict=True) if rows else [[]] * len(schema)
        return left.sparkSession.createDataFrame(pa.table(dict(zip(schema.names, map(list, columns), strict=True))), schema)

    def met(side: int, table: DataFrame, how: str) -> DataFrame:
        df, ks, x = sides[side]
        return df.join(F.broadcast(table), _all([k == F.col(n) for k, n in zip(ks, names, strict=True)]), how).withColumn("_bin", _bin(x))

    counts = [[[0] * (BINS + 2) for _ in heavy] for _ in (0, 1)]
    for i in (0, 1) if heavy else ():
        for key, at_bin, rows_in in met(i, small_table("_key", T.IntegerType(), list(range(len(heavy)))), "inner").groupBy("_key", "_bin").count().collect():
            counts[i][key][at_bin] = rows_in
    cells = [_cells(x, y, up) for x, y in zip(counts[b], counts[s], strict=True)]
    table = small_table("_first", T.ArrayType(T.IntegerType()), [f for f, _ in cells])

    first = lambda x: F.get(F.col("_first"), x)
    start, end = first(F.col("_bin")), first(F.col("_bin") + 1)  # of a bin's cells
    to = F.sequence(start, first(F.lit(BINS + 2)) - 1) if up else F.sequence(F.lit(0), end - 1)
    cell = start
    if any(f[-1] > BINS + 2 for f, _ in cells):  # some bin has several
        hashed = [c.name for c in (left, right)[b].schema if not any(t in c.dataType.simpleString() for t in ("map<", "variant"))]
        cell = start + F.pmod(F.xxhash64(*hashed), end - start).cast("int")
    big = met(b, table, "left").withColumn("_cell", F.coalesce(cell, F.lit(0)))
    small = met(s, table, "left").withColumn("_to", F.explode(F.coalesce(to, F.array(F.lit(0)))))

    pairs = int(total - sum(r["_pairs"] for r in heavy)) + sum(p for _, p in cells)
    tasks = max(1 + min(pairs // PAIRS, sum(n) // 4096), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drop = [*names, "_lo", "_hi", "_first", "_bin"]
    # dealt by number, so that tasks aren't joined for having few bytes; merged, so that the repeated side isn't broadcast
    big = big.drop(*drop).repartition(tasks, *[k[b] for k in keys], "_cell")
    small = small.drop(*drop).repartition(tasks, *[k[s] for k in keys], "_to")
    out = big.join(small.hint("merge"), _all([*[k[b] == k[s] for k in keys], F.col("_cell") == F.col("_to"), *rest]))
    return out.select(*left.columns, *right.columns)
