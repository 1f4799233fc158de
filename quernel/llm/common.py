"""Helpers that all corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: space and U+0009 to U+000D.
SEPARATORS = " \t\n\u000b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a key table that may be broadcast (at some 150 bytes a row 40 MB); a longer table is joined by a shuffle.
BROADCAST_ROWS = 250_000


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one machine takes a temporary folder; on a cluster it is an error, as machines don't share theirs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and re.fullmatch(r"local(\[[^\]]*\])?", context.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table written beside the checkpoints, for loops: a checkpoint keeps the estimated size of its plan, which is
    a product at each join, so that over many rounds these numbers themselves grow too long to compute with."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, by workers that find this package where the driver does (on a cluster, where it is installed or given by --py-files)."""
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], **types: str) -> DataFrame:
    """A few rows from expressions alone, without Python on the executors; types: of the columns, by name."""
    structs = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, types.items(), strict=True)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def text_of(name: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate value once a row and bind it in body; the optimizer can't copy it into each use."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """value, which the optimizer then computes in one place: it doesn't move or copy what isn't deterministic, so a filter on parts of it doesn't compute it again for each part."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_words_of(text: Column) -> Column:
    """The number of words: of separators that stand before a word, without building the words."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few enough rows; df should be checkpointed, as it is counted."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of pairs of columns."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the ids in dropped; long texts stay where they are if dropped is short enough to broadcast.

    dropped should be checkpointed. Of rows that share a surviving id, all stay.
    """
    gone = small(dropped.select(F.col(id_col).alias("_gone")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
