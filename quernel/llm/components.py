"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import checkpoint, written

#: Nodes with more than 1/HEAVY of all links are joined by broadcast: of those there are at most HEAVY.
HEAVY = 10_000


def _hung(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """links (u, v) with m of least (u, m, n) for their u; n: the links of u.

    The links of heavy nodes stay where they are; those of others are dealt out by node, at most total / HEAVY to one.
    """
    heavy = F.broadcast(least.where(F.col("n") * HEAVY > total).select(F.col("u").alias("hu"), F.col("m").alias("hm")))  # at most HEAVY rows
    light = least.where(F.col("n") * HEAVY <= total).select("u", "m")
    marked = links.join(heavy, F.col("u") == F.col("hu"), "left")
    return marked.where("hu is not null").select("u", "v", F.col("hm").alias("m")).union(marked.where("hu is null").select("u", "v").join(light, "u").select("u", "v", "m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the smallest node of its component, for each node that has a link to another.

    Each round hangs the neighbours of a node on the smallest of them; the number of rounds grows with the logarithm
    of the longest path. Minima are found map-side and given back to the links of heavy nodes by broadcast, so a node
    with very many links is no hot key.

    Defined results: links with a null end, and links of a node to itself, are ignored; repeated links count once; no
    links give no rows. Extra columns are ignored.
    """
    rest = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok")).where("ok and u > v").select("u", "v").distinct())
    total, seen = rest.count(), None
    while total:
        both = rest.union(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n"))
        rest = checkpoint(_hung(both.where("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpoint(rest.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        hung = _hung(rest, least, rest.count())
        rest = written(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct())
        total, mark = rest.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if (total, mark) == seen:
            break
        seen = total, mark
    return rest.select(F.col("u").alias("node"), F.col("v").alias("root")).union(rest.select(F.col("v"), F.col("v")).distinct())
