"""Co-training, by held-out accuracy."""

import numpy as np

from quernel.llm import cotrain
from quernel.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = cotrain.quality(docs, train).join(test, "doc_id").toPandas()
    assert len(got) > 1000
    assert ((got["score"] > 0.5) == (got["quality"] == 1)).mean() > 0.97
    assert got["score"][got["quality"] == 1].gt(0.5).mean() > 0.98
    assert abs(got["score"].mean() - got["quality"].mean()) < 0.03  # calibrated


def test_hard(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label double, id string"
    docs = spark.createDataFrame([(1, None, None, None, None, 1.0, "x"), (1, "", "en", "s", 0, 2.0, None), (None, "a b", "en", None, 3, None, "y"), (4, "\x00 é " * 9000, "??", "s", -5, 0.0, "z")], schema)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 0)], "doc_id long, quality int")
    got = cotrain.quality(docs, labels).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 for r in got)
    assert cotrain.quality(docs.limit(0), labels).count() == 0
    x = np.random.default_rng(0).normal(size=(200, 3)).astype(np.float32)
    w = cotrain.fit(x, (x[:, 0] > 0).astype(float))
    assert ((x @ w > 0) == (x[:, 0] > 0)).mean() > 0.95


def test_foreign_labels_change_nothing(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    foreign = spark.range(10**9, 10**9 + 200_000).selectExpr("id as doc_id", "0 as quality")
    both = [cotrain.quality(docs, x, rounds=1).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, labels.unionByName(foreign))]
    assert both[0] == both[1] and len({r["score"] for r in both[0]}) > 100


def test_surest_of_all_rows(spark):
    """The pseudo-labels of a round against a plain version over all rows."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    others = cotrain._slim(docs, "doc_id", "text").selectExpr("*", "id as key")
    r = np.random.default_rng(1)
    weights = {"text": r.normal(size=cotrain.TEXT_SIZE), "meta": r.normal(size=cotrain.META_SIZE)}
    ask = cotrain._surest(others, 20)
    rows = others.orderBy("key").collect()
    features = [(cotrain.text_features(bytes(x["text"])), cotrain.meta_features(x["lang"], x["source"], x["n_chars"])) for x in rows]
    gone = set()
    for _ in range(2):
        want = set()
        for i, v in enumerate(("text", "meta")):
            score = [(float(f[i] @ weights[v]), x["key"]) for x, f in zip(rows, features, strict=True) if x["key"] not in gone]
            want |= {(v, 1.0, k) for _, k in sorted([(-s, k) for s, k in score if s > 2])[:5]} | {(v, 0.0, k) for _, k in sorted([(s, k) for s, k in score if s < -2])[:15]}
        got = ask(weights, 0.25)
        gone |= {k for _, _, k in want}
        assert len(got) == len(want) and {(v, y) for v, y, *_ in got} == {(v, y) for v, y, _ in want}
        texts = lambda found: sorted((v, y, x) for v, y, x in found)
        plain = {row["key"]: f[0].tobytes() + f[1].tobytes() for row, f in zip(rows, features, strict=True)}
        assert texts((v, y, t.tobytes() + m.tobytes()) for v, y, t, m in got) == texts((v, y, plain[k]) for v, y, k in want)
