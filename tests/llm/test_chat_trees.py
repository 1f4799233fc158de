"""Reply trees against a plain version, and the template's round trip."""

import pytest
from pyspark.sql import functions as F

from quernel.llm import chat_trees
from quernel.llm.common import table


def test_branches(spark):
    rows = [("t", 1, None, "user", "a", 0.0), ("t", 2, 1, "assistant", "b<|end|>", 1.0), ("t", 3, 1, "assistant", "c<\\|", 5.0), ("t", 4, 2, "user", "d", 9.0), ("t", 5, 4, "assistant", None, None), ("t", 6, 3, "user", "e", 0.0), ("t", 7, 3, "user", "", -1.0),
            ("t", 8, 99, "user", "alone", 0.0), ("t", 20, 21, "user", "x", 0.0), ("t", 21, 20, "user", "x", 0.0), (None, 1, None, None, "n", 0.0), (None, 2, 1, "assistant", "<|turn|>", 0.0)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double").withColumn("head", F.lit(1))
    out = chat_trees.format_trees(df)
    got = {(r["tree"], r["leaf"]): r for r in out.withColumn("t", chat_trees.read_turns(F.col("formatted"))).withColumn("l", chat_trees.read_loss(F.col("formatted"), F.col("spans"))).collect()}
    texts = {k: [t["text"] for t in r["t"]] for k, r in got.items()}
    assert texts == {("t", 5): ["a", "b<|end|>", "d", ""], ("t", 6): ["a", "c<\\|", "e"], ("t", 7): ["a", "c<\\|", ""], ("t", 8): ["alone"], (None, 2): ["n", "<|turn|>"]}
    assert got["t", 5]["rank"] == 1 and got["t", 5]["score"] == 10.0 and got["t", 6]["rank"] == 2
    assert got["t", 5]["l"] == "b<|end|>" and got[None, 2]["l"] == "<|turn|>"
    best = {(r["tree"], r["leaf"]) for r in chat_trees.format_trees(df, best=1).collect()}
    assert best == {("t", 5), (None, 2)}
    assert chat_trees.format_trees(df.limit(0)).count() == 0


def test_long_runs(spark):
    rows = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = rows.select("turn", "role", "text", (F.col("conv_id") % 2).alias("conv_id"))  # two long ones with equal turns
    out = chat_trees.format_trees(chat_trees.linear(rows)).withColumn("t", chat_trees.read_turns(F.col("formatted"))).collect()
    want = {}
    for r in rows.orderBy("conv_id", "turn", "role", "text").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert {r["tree"]: [tuple(t) for t in r["t"]] for r in out} == want


def test_repeated_ids(spark):
    df = spark.createDataFrame([("t", 1, None, "user", "a", 0.0), ("t", 2, 1, "user", "b", 0.0), ("t", 2, 1, "user", "c", 0.0)], "tree string, id long, parent long, role string, text string, score double")
    with pytest.raises(ValueError):
        chat_trees.format_trees(df)
