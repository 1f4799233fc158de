"""Operators that SQL can't express, against plain versions."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pyarrow.dataset as ds
import pytest

from quernel.llm import queries, simhash, substring_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()


def hard_texts():
    """Edge cases: repeats at the ends, overlapping repeats, one word again and again, short and odd texts, null."""
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(40)] + ["été", "ß", " x", "a​b"]
    passage = [r.choice(vocab) for _ in range(60)]
    out = [None, "", " \n\t ", "x", "x y z", "the " * 90, "the " * 34, "the " * 35, "the " * 36, " ".join(passage), " ".join(passage), " ".join(passage[:34]), " ".join(passage[:35])]
    for _ in range(40):
        a, b = sorted(r.sample(range(61), 2))
        pre, post = ([r.choice(vocab) for _ in range(r.randrange(50))] for _ in range(2))
        out.append(r.choice([" ", "\n", " \t "]).join([*pre, *passage[a:b], *post]))
    return out


def test_repeats_hard(spark):
    texts = hard_texts()
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)]
    for window in (35, 6, 1):
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, places string, _id int").repartition(5), window=window).collect()
        want = Counter((i, *w) for (i, *_), w in zip(rows, brute.without_repeats(texts, window)))
        assert Counter(tuple(r) for r in got) == want


def test_repeats_on_documents(spark, documents):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op5_substring_dedup(spark, SF).collect()}
    want = brute.without_repeats([d["text"] for d in documents], 35)
    assert got == {d["doc_id"]: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in zip(documents, want)}


def test_near_duplicates_on_documents(spark, documents):
    rows = [(d["doc_id"], brute.fingerprint(d["text"], 4)) for d in documents]
    want = brute.near_components(rows, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, SF).collect()}
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in rows}


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_links_of_any_number_of_segments(spark, monkeypatch, segments):
    """Chains and dense groups, over blocks that are forced to be small."""
    r = random.Random(segments)
    fps = [r.getrandbits(64) for _ in range(60)]
    for centre in (0, 1 << 63 | 5, r.getrandbits(64)):
        fps += [centre] + [centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))) for _ in range(120)]
    fps = sorted(set(fps))
    monkeypatch.setattr(simhash, "n_segments", lambda n, radius: segments)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").checkpoint()
    links = simhash.near_links(nodes, 4, block=40).collect()
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        parent[max(find(a), find(b))] = min(find(a), find(b))
    rows = list(enumerate(fps))
    want = brute.near_components(rows, 4)
    assert {i: find(x) for i, x in rows} == {i: fps[j] for i, j in want.items()}


def test_fingerprints_hard(spark):
    texts = hard_texts() + ["A b C d E", "Äpfel ÄPFEL İ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width in (1, 4, 5):
        got = {r["id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(rows, width=width).collect()}
        assert got == {i: brute.fingerprint(t, width) for i, t in enumerate(texts)}


@pytest.mark.parametrize("lanes", [1, 2])
def test_large_entries(lanes):
    """Many members and lookers in one entry, against all pairs."""
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (30, lanes), dtype=np.uint64)
    flip = np.zeros((400, lanes), np.uint64)
    flip[:, 0] = np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[r.integers(0, 30, 400)] ^ flip, base]), axis=0)
    member = r.random(len(fps)) < 0.5
    joined = simhash._Forest()
    for x, y in simhash._dense(fps, member, 4):
        assert simhash._near(x, y, 4).all()
        joined.spanning(x, y)
    names = fps[:, 0].tolist() if lanes == 1 else [x.tobytes() for x in fps]
    for i in range(len(fps)):
        for j in np.flatnonzero(simhash._near(fps, fps[i], 4)):
            if member[i] and i != j:
                assert joined.find(names[i]) == joined.find(names[j])


def test_similar_texts_over_lanes(spark):
    """Nearly all copies with a few words changed meet; other texts don't."""
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(40):
        text = [r.choice(vocab) for _ in range(300)]
        for copy in range(3):
            changed = list(text)
            for at in r.sample(range(300), 3 * copy):
                changed[at] = r.choice(vocab)
            rows.append((g * 10 + copy, " ".join(changed)))
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), lanes=3).collect()}
    assert all(c // 10 == i // 10 for i, c in got.items())
    assert sum(c == i // 10 * 10 for i, c in got.items()) >= 114


def test_repeats_verify_words(spark):
    """Words and word sequences that a sum of powers modulo 2**64 can't tell apart."""
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in thue) for flip in (0, 1))
    own = [f"w{i}" for i in range(35)]
    texts = [" ".join([*own[:17], x, *own[18:]]) for x in (a, b)] + [" ".join("xy"[x ^ flip] for x in thue[:1024]) for flip in (0, 1)] + ["x" * 70 + " " + "y" * 100_000, "z " + "x" * 64]
    for window in (35, 1):
        got = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=window).collect()
        assert sorted(tuple(r) for r in got) == [(i, *w) for i, w in enumerate(brute.without_repeats(texts, window))]


def test_repeats_of_many_null_ids(spark):
    texts = [" ".join(f"{'r' if i < 12_000 else 'u'}{i // 2 if i < 12_000 else i}.{k}" for k in range(36)) for i in range(20_000)]
    got = substring_dedup.remove_repeats(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).groupBy("n_removed").count().collect()
    assert {tuple(r) for r in got} == {(36, 12_000), (0, 8_000)}
