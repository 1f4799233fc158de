"""Operator 6: mixing sources to target weights.

Rows get a hash-random key; within each source they are ordered by it. Sizes are summed by ranges of the key and the
sums are accumulated, so each source's budget falls into one range; only that range is ordered row by row. A row is
taken or not by comparing its key with its source's cut, so texts are never shuffled and a source that holds any share
of the rows is as good as any other.

Targets: all sources share `share` times all sizes by weight; a target stops at `most_epochs` times its source's size
and the excess is shared anew by weight until none is above. A budget (the rounded target) of more than the source is
repeated epochs and a cut of one more.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null id counts as the
empty string for the key. Rows of equal source, key and id are one unit: a cut within it takes the same part of each.
An empty table gives an empty result. Extra columns are ignored by mix(); take() keeps all columns of docs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import checkpoint, n_words_of, small, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
KEY_BITS = 60
#: Rows in a range of keys, on average.
RANGE_ROWS = 20_000


def key_of(id_col: str) -> Column:
    """A hash-random number of KEY_BITS bits."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """sources (source, source_size), one row each, with target: the share by weight that fills no source above its cap.

    In order of cap by weight, those that are full at the common level are a prefix, so running sums find the level.
    """
    in_order, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    caps = sources.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * most_epochs).withColumn("all", F.sum("source_size").over(everything) * share)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    caps = caps.withColumn("full", left * F.col("weight") >= F.col("cap") * weight_left)
    of_full = lambda c, full: F.coalesce(F.sum(F.when(F.col("full") == full, F.col(c))).over(everything), F.lit(0.0))
    level = (F.col("all") - of_full("cap", True)) * F.col("weight") / of_full("weight", False)
    return caps.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level)).select("source", "source_size", "target")


def cuts(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with epochs, and cut_key, cut_id, cut_size and tail where one more epoch is cut.

    sized: id, source, size, key. tail: the words that the cut takes of the unit of rows at the cut.
    """
    bits = max(0, math.ceil(math.log2(max(1, sized.count()) / RANGE_ROWS)))
    bucket = F.shiftright("key", KEY_BITS - bits)
    budget = F.round("target").cast("long")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    ranges = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket"))
    ranges = ranges.select(F.col("source").alias("_source"), "bucket", "sum", upto.alias("upto"))
    at = goals.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("rest") > F.col("upto") - F.col("sum")) & (F.col("rest") <= F.col("upto")))
    at = small(checkpoint(at.select("_source", F.col("bucket").alias("_bucket"), "rest", (F.col("upto") - F.col("sum")).alias("before"))))
    near = sized.join(at, F.col("source").eqNullSafe(F.col("_source")) & (bucket == F.col("_bucket")))
    units = near.groupBy("_source", "key", "id").agg(F.sum("size").alias("unit"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    after = F.col("before") + F.sum("unit").over(Window.partitionBy("_source").orderBy("key", "id"))
    found = units.withColumn("after", after).where("rest > after - unit and rest <= after")
    found = found.select("_source", F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("unit").alias("cut_size"), (F.col("rest") - F.col("after") + F.col("unit")).alias("tail"))
    return goals.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words_of(text_of(text_col)).alias("size"), key_of(id_col).alias("key"))


def _plan(docs: DataFrame, id_col: str, source_col: str, text_col: str, goals: dict) -> tuple[DataFrame, DataFrame]:
    sized = checkpoint(_sized(docs, id_col, source_col, text_col))
    sources = checkpoint(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    return sized, small(checkpoint(cuts(sized, targets(sources, **goals)).withColumnRenamed("source", "_of")))


def _place(key: Column, own: Column) -> tuple[Column, Column]:
    """Whether a row stands before its source's cut, and at it. Null ids come first."""
    at = (key == F.col("cut_key")) & own.eqNullSafe(F.col("cut_id"))
    before = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & F.col("cut_id").isNotNull() & (own.isNull() | (own < F.col("cut_id"))))
    return F.coalesce(before, F.lit(False)), F.coalesce(at & F.col("cut_key").isNotNull(), F.lit(False))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **goals) -> DataFrame:
    """A row for each row of docs: id_col, source, size, source_size, target (its source's), taken (words, repeats counted)."""
    sized, plan = _plan(docs, id_col, source_col, text_col, goals)
    before, at = _place(F.col("key"), F.col("id"))
    part = F.when(before, F.col("size")).when(at, F.floor(F.col("tail") * F.col("size") / F.col("cut_size"))).otherwise(0)
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("_of")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("epochs") + part).cast("long").alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **goals) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken; the row at a cut whole, if at least half of it is taken."""
    _, plan = _plan(docs, id_col, source_col, text_col, goals)
    before, at = _place(F.col("_key"), F.col(id_col))
    more = F.when(before | (at & (F.col("tail") * 2 >= F.col("cut_size"))), 1).otherwise(0)
    own = docs.select(*[F.col(c).alias(c) for c in docs.columns], F.col(source_col).cast("string").alias("_source"), key_of(id_col).alias("_key"))
    chosen = own.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_copies", (F.col("epochs") + more).cast("int")).where("_copies > 0")
    repeated = chosen.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy"))
    return repeated.select(*docs.columns)


#: mix() as DuckDB SQL.
ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM sized GROUP BY source),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS goal FROM sources),
filled AS (
  SELECT *, (goal - coalesce(sum(cap) OVER w, 0)) * weight >= cap * (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS is_full FROM caps
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (goal - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * weight
         / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target FROM filled),
cut AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size = 0 THEN 0 ELSE CAST(round(g.target) AS BIGINT) // g.source_size END AS epochs,
         CAST(round(g.target) AS BIGINT) AS budget, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - (upto - size))) AS BIGINT) AS taken FROM cut
"""
