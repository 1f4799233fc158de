"""Operator 3: exact duplicates by progressive refinement.

Rows are grouped by length, then by a hash of a short prefix, and only texts that still share both with another row
are hashed whole. Each step aggregates map-side, so a group of copies of any size reaches a task as one row a
partition; texts are never shuffled. If more groups of length and prefix survive than may be broadcast, finding their
texts would take a shuffle of texts: then all texts are hashed whole where they are read, with the same results.

Defined results: a null text equals the empty text. Of equal texts the row with the largest id stays (null ids are
smallest); if that very row is repeated, exactly one of its copies stays. Every input row has one output row.
An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm import common
from quernel.llm.common import checkpoint, small, text_of, without

PREFIX_CHARS = 128


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept, and the columns of carry.

    carry: further expressions over the text, as _text, and the other columns of docs; they are computed in the last scan.
    """
    sized = docs.withColumn("_text", text_of(text_col)).withColumn("_len", F.octet_length("_text"))
    prefix = F.xxhash64(F.substring("_text", 1, prefix_chars))

    lengths = checkpoint(sized.groupBy("_len").count().where("count > 1").select("_len"))
    by_prefix = sized.select("_len", prefix.alias("_prefix")).join(small(lengths), "_len", "left_semi")
    alike = checkpoint(by_prefix.groupBy("_len", "_prefix").count().where("count > 1").select("_len", "_prefix", F.lit(True).alias("_alike")))
    n_alike = alike.limit(common.BROADCAST_ROWS + 1).count()

    scanned = sized.withColumn("_prefix", prefix)
    whole = F.when(F.col("_alike"), F.sha2(F.col("_text"), 256))
    if 0 < n_alike <= common.BROADCAST_ROWS:
        scanned = scanned.join(F.broadcast(alike), ["_len", "_prefix"], "left")
    else:
        scanned = scanned.withColumn("_alike", F.lit(n_alike > 0))
    hashed = scanned.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), "_len", whole.alias("_hash"), *[v.alias(k) for k, v in (carry or {}).items()])
    hashed = checkpoint(hashed)

    # checkpointed, the groups have no partitioning of their own: a long join is then one whose hot keys Spark splits
    groups = hashed.where("_hash is not null").groupBy("_len", "_hash").agg(F.max(F.struct(F.col(id_col).alias("id"), F.col("_row").alias("row"))).alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    out = hashed.join(small(checkpoint(groups)), ["_len", "_hash"], "left")
    alone = F.col("_n").isNull()
    return out.select(
        F.col(id_col),
        F.when(alone, F.col(id_col)).otherwise(F.col("_keep.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_keep.row") == F.col("_row"))).alias("kept"),
        *(carry or {}),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup doesn't keep."""
    found = checkpoint(exact_dedup(docs, id_col, text_col, carry={"_digest": F.sha2("_text", 256)}).groupBy(id_col, "_digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    gone = found.where("not kept")
    keyed = docs.withColumn("_digest", F.sha2(text_of(text_col), 256))
    lost = small(gone.select(F.col(id_col).alias("_id"), F.col("_digest").alias("_d")))
    rest = keyed.join(lost, keyed[id_col].eqNullSafe(lost["_id"]) & (keyed["_digest"] == lost["_d"]), "left_anti")
    return one_a_key(rest, found.where("kept and n > 1"), [id_col, "_digest"]).drop("_digest")


def one_a_key(docs: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """docs with one row for each key in repeated: the smallest, found map-side; repeated is checkpointed."""
    if not repeated.limit(1).count():
        return docs
    found = small(repeated.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)]))
    match = None
    for i, k in enumerate(keys):
        match = docs[k].eqNullSafe(found[f"_r{i}"]) if match is None else match & docs[k].eqNullSafe(found[f"_r{i}"])
    first = docs.join(found, match, "left_semi").groupBy(*keys).agg(F.min(F.struct(*docs.columns)).alias("_first"))
    return docs.join(found, match, "left_anti").unionByName(first.select("_first.*"))


__all__ = ["drop_exact_duplicates", "exact_dedup", "one_a_key", "without"]
