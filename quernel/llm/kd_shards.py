"""Operator 1: shards from a k-d tree over metadata, with law `bytes`.

The points of the tree are groups of equal texts, weighted by their bytes, so copies share a shard. Only a group of more
than 1/WHOLE of a shard's bytes is cut, by the hash of its ids, into points of 1/SPLIT of a shard, or no cut could be
near a median.
Each node is cut along the dimension in which it is widest, at the weighted quantile that gives both sides the bytes
of their leaves. The quantile is found by distributed histograms over a 63-bit key (coordinate, then a hash of the
point): each pass sums the weights of bins of the range that still holds it, for all nodes of a level at once, until
the bin is light. The driver sees a bounded number of bins and a row a node.

Numbers are coordinates by value, strings by their hash: equal values are together, their order means nothing.

Defined results: size is the UTF-8 bytes of the text plus 1, a null text has none. Null metadata has coordinate 0.
Every input row has one output row; slots are gapless from 0 in each shard. A shard may be empty if there are fewer
texts than shards. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import checkpoint, small, text_of

DIMENSIONS = ("lang", "source", "n_chars", "doc_id")
#: A cut is this near to its quantile, in shards, and a group that is cut has points of this size.
SPLIT = 400
#: Copies of up to this part of a shard stay together.
WHOLE = 20
#: Groups of more than 1/HEAVY of all rows find their shard by broadcast: of those there are at most HEAVY.
HEAVY = 10_000
COORDINATE_BITS, HASH_BITS = 31, 32
#: Bins that one pass may send to the driver.
BINS = 1 << 17
SLOT_ROWS = 100_000


def _coordinates(slim: DataFrame, names: list[str]) -> dict[str, F.Column]:
    """A coordinate below 2**31 for each dimension."""
    top = (1 << COORDINATE_BITS) - 1
    numbers = [n for n in names if isinstance(slim.schema[f"_d_{n}"].dataType, T.NumericType)]
    span = slim.agg(*[f(F.col(f"_d_{n}").cast("double")) for n in numbers for f in (F.min, F.max)], F.lit(0)).first()
    out = {}
    for n in names:
        c = F.col(f"_d_{n}")
        if n in numbers:
            low, high = span[2 * numbers.index(n)], span[2 * numbers.index(n) + 1]
            wide = (high - low) if low is not None and high > low else None
            x = F.floor((c.cast("double") - low) / wide * top) if wide else F.lit(0)
        else:
            x = F.when(c.isNotNull(), F.shiftrightunsigned(F.xxhash64(c.cast("string")), 64 - COORDINATE_BITS))
        out[n] = F.coalesce(x, F.lit(0)).cast("long")
    return out


def _cut(points: DataFrame, nodes: dict[int, int], weights: dict[int, tuple], dims: list[str]) -> list[tuple[int, int, int, int]]:
    """(node, dimension, cut, first leaf on the right) for each node of more than one leaf; nodes: first leaf to leaves."""
    spark = points.sparkSession
    bits = max(1, min(12, int(math.log2(max(2, BINS // max(1, len(nodes)))))))
    open_, done = {}, []
    for node, leaves in nodes.items():
        if leaves > 1 and node in weights:
            total, *spans = weights[node]
            dim = max(range(len(dims)), key=lambda i: spans[i])
            goal = total * (leaves // 2) / leaves
            open_[node] = [dim, 0, COORDINATE_BITS + HASH_BITS, 0.0, goal, total / leaves / SPLIT]  # dimension, prefix, bits below it, weight before it, goal, near enough
    while open_:
        table = spark.createDataFrame([(n, x[0], x[1], x[2], max(0, x[2] - bits)) for n, x in open_.items()], "node int, dim int, prefix long, below int, next int")
        key = F.get("coords", F.col("dim")) * (1 << HASH_BITS) + F.col("hash")
        inside = points.join(F.broadcast(table), "node").withColumn("key", key).where(F.expr("shiftright(key, below) = prefix"))
        bins: dict[int, list] = {}
        for r in inside.groupBy("node", F.expr("shiftright(key, next)").alias("bin")).agg(F.sum("weight").alias("weight")).collect():  # at most BINS rows
            bins.setdefault(r["node"], []).append((r["bin"], r["weight"]))
        for node, x in list(open_.items()):
            dim, prefix, below, before, goal, near = x
            below = max(0, below - bits)
            chosen = None
            for b, w in sorted(bins.get(node, [])):
                if before + w >= goal:
                    chosen = (b, w)
                    break
                before += w
            if chosen is None:  # no weight is left: cut behind everything
                done.append((node, dim, (prefix + 1) << x[2], node + nodes[node] // 2))
                del open_[node]
            elif chosen[1] <= near or below == 0:
                b, w = chosen
                if before + w - goal < goal - before:
                    b += 1
                done.append((node, dim, b << below, node + nodes[node] // 2))
                del open_[node]
            else:
                open_[node] = [dim, chosen[0], below, before, goal, near]
    return done


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, shard and slot for each row of docs. Give n_shards, or target_bytes for as many as reach it."""
    text = text_of(text_col)
    dims = [d for d in dimensions if d in docs.columns and d != text_col]
    slim = docs.select(
        F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("text"), *[F.col(d).alias(f"_d_{d}") for d in dims],
    )
    slim = checkpoint(slim)
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = n_shards or max(1, math.ceil(total / target_bytes))
    coords = _coordinates(slim, dims)

    same_text = ["text", "crc", "size"]
    groups = checkpoint(slim.groupBy(*same_text).agg(F.sum("size").alias("w"), F.count("*").alias("n")).where(f"n > 1 and (w * {shards * WHOLE} > {total} or n * {HEAVY} > {rows})"))
    parts = F.when(F.col("w") * shards * WHOLE > total, F.ceil(F.col("w") * (shards * SPLIT / max(1, total)))).otherwise(1).cast("int")
    hot = small(groups.select(*same_text, parts.alias("parts"), (F.col("n") * HEAVY > rows).alias("heavy")))  # at most HEAVY + shards * WHOLE rows
    of_row = F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.col("row").cast("string")))
    slim = slim.join(hot, same_text, "left").withColumn("part", F.coalesce(F.pmod(of_row, F.col("parts")), F.lit(0)).cast("int")).withColumn("heavy", F.coalesce("heavy", F.lit(False))).drop("parts")
    keys = [*same_text, "heavy", "part"]

    low = F.xxhash64("text", "part").bitwiseAND((1 << HASH_BITS) - 1)
    points = slim.groupBy(*keys).agg(F.sum("size").alias("weight"), F.array(*[F.min(coords[d]) for d in dims], F.min(low)).alias("coords"))
    points = checkpoint(points.select(*keys, "weight", "coords", low.alias("hash"), F.lit(0).alias("node")))
    dims = [*dims, "hash"]
    nodes = {0: shards}
    while any(n > 1 for n in nodes.values()):
        spans = [F.max(F.get("coords", F.lit(i))) - F.min(F.get("coords", F.lit(i))) for i in range(len(dims) - 1)]
        weights = {r[0]: (float(r[1]), *r[2:], 0) for r in points.groupBy("node").agg(F.sum("weight"), *spans).collect()}  # a row a node
        cuts = _cut(points, nodes, weights, dims)
        if cuts:
            table = F.broadcast(points.sparkSession.createDataFrame(cuts, "node int, dim int, cut long, right int"))
            beyond = F.get("coords", F.col("dim")) * (1 << HASH_BITS) + F.col("hash") >= F.col("cut")
            points = checkpoint(points.join(table, "node", "left").select(*keys, "weight", "coords", "hash", F.when(beyond, F.col("right")).otherwise(F.col("node")).alias("node")))
        nodes = reduce(lambda a, b: a | b, [{n: 1} if k == 1 else {n: k // 2, n + k // 2: k - k // 2} for n, k in nodes.items()])

    found = points.select(*keys, F.col("node").alias("shard"))
    near = small(checkpoint(found.where("heavy")))  # the parts of at most HEAVY groups, which are less than HEAVY + shards * SPLIT
    joined = [slim.where("heavy").join(near, keys), slim.where("not heavy").join(found.where("not heavy"), keys)]
    placed = checkpoint(joined[0].union(joined[1]).select("_id", "row", "size", "crc", "shard"))
    bucket = F.pmod(F.xxhash64("row"), F.lit(max(1, rows // (shards * SLOT_ROWS) * 2))).alias("bucket")
    counts = placed.groupBy("shard", bucket).agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slot = F.col("first") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    return placed.withColumn("bucket", bucket).join(counts, ["shard", "bucket"]).select(F.col("_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))
