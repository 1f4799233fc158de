"""Quality rules against a plain version, and against labels."""

import brute
import pyarrow.dataset as ds

from quernel.llm import quality_rules, queries
from quernel.llm.common import table

SF = "/root/testdata/sf0.01"
HARD = [None, "", " \n ", "a b\n\na b\n a b\r\n", "x y z w v u t s x y z w v u t s", "the " * 200, "é" * 70, "a\x1cb c | # <|>\n" * 3, ("w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 2 + "q r s t u ") * 2, "\n".join(f"l{i}" for i in range(30))]


def plain(text):
    w = brute.words(text)
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    repeats = brute.repeat_words(w)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeats, "base_failed": len(w) < 20 or 100 * repeats > 30 * len(w),
    }


def test_counts_on_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()}
    rows = queries.op10_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert not (r["kept"] and r["base_failed"])


def test_counts_hard(spark):
    docs = spark.createDataFrame([(i, t, None, 5, "k") for i, t in enumerate(HARD)], "doc_id long, text string, lang string, n_words int, kept string")
    for r in quality_rules.quality_rules(docs).collect():
        want = plain(HARD[r["doc_id"]])
        assert {k: r[k] for k in want} == want
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r["n_words"] for r in kept.collect()} <= {5}
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_good_documents_stay(spark):
    """No rule but the base rejects a document that is labelled good; nearly all others go."""
    out = quality_rules.quality_rules(table(spark, "/root/testdata/sf0.1", "documents")).join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id")
    assert out.where("quality = 1 and not base_failed and not kept").count() == 0
    assert out.where("quality = 0 and kept").count() <= 0.1 * out.where("quality = 0").count()
