"""Near-dedup and substring dedup over empty tables, and rows that repeat, tie or hold nulls."""

from collections import Counter

from quernel.llm import common, exact_dedup, simhash, substring_dedup

ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, ""), (None, "only"), (5, "x y " * 30_000), (6, "x y " * 30_000)]
SCHEMA = "doc_id long, text string, fp int, least string, root int, key int, place string, id string, tag int"


def test_near_dedup(spark):
    docs = spark.createDataFrame([(i, t, 1, "l", 2, 3, "p", "i", 4) for i, t in ROWS], SCHEMA)
    for lanes in (1, 2):
        got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, lanes=lanes, radius=0).collect())
        assert got == Counter([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (None, None), (5, 5), (6, 5)])
        assert simhash.near_duplicates(docs.limit(0), lanes=lanes).count() == 0
    left = simhash.one_of_each(docs, lanes=2, radius=0)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([1, 1, None, None, 3, 5])


def test_substrings(spark):
    docs = spark.createDataFrame([(i, t, 1, "l", 2, 3, "p", "i", 4) for i, t in ROWS], SCHEMA)
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[5, 60_000] == 60_000 and got[1, 6] == 0 and got[3, 0] == 0
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_exact_dedup_without_broadcasts(spark, monkeypatch):
    """Where no list may be broadcast, results are the same."""
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ROWS)], "doc_id long, text string")
    want = Counter(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    assert sum(r[3] * n for r, n in want.items()) == len({t or "" for _, t in ROWS})
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want
