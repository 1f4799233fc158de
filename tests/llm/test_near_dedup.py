"""Near-dedup at a similarity: what the search finds at any size, and that only similar documents are dropped."""

import itertools
import random

import brute
import corpus_pipeline
import numpy as np
import pytest

from quernel.llm import simhash

LANES = 3


def pairs_at(similarity, n, rng):
    """Fingerprints of n pairs of sets of 500 elements, of this similarity."""
    both = round(500 * similarity)
    own = (500 - both) // 2
    lanes = lambda x: np.stack([np.frombuffer(simhash._majority(x if k == 0 else simhash.mixed(x + np.uint64(k * simhash.GOLDEN & simhash.MASK))), ">u8").astype(np.uint64)[0] for k in range(LANES)])
    out = []
    for _ in range(n):
        x = rng.integers(0, 1 << 64, both + 2 * own, dtype=np.uint64)
        out.append((lanes(x[: both + own]), lanes(x[own:])))
    return out


@pytest.mark.parametrize("size", [10**4, 10**6, 10**8, 5 * 10**9])
def test_recall_at_any_size(spark, monkeypatch, size):
    """Pairs of a similarity of 0.8, 0.85 and 0.9, searched as among that many fingerprints."""
    as_for, every = simhash.lane_segments, simhash.near_links
    monkeypatch.setattr(simhash, "lane_segments", lambda n, share, lanes: as_for(size, share, lanes))
    made = {}
    monkeypatch.setattr(simhash, "near_links", lambda nodes, radius, lanes, share: made.update(radius=radius, share=share) or every(nodes, radius, lanes=lanes, share=share))
    simhash.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), similarity=0.8, lanes=LANES)
    rng = np.random.default_rng(7)
    n = 400
    pairs = {s: pairs_at(s, n, rng) for s in (0.8, 0.85, 0.9)}
    names = lambda x: tuple(x.view(np.int64).tolist())
    rows = [(names(x),) for found in pairs.values() for pair in found for x in pair]
    nodes = simhash.checkpoint(spark.createDataFrame(rows, "fp struct<f0:long,f1:long,f2:long>"))
    links = {frozenset((tuple(r["a"]), tuple(r["b"]))) for r in every(nodes, made["radius"], lanes=LANES, share=made["share"]).collect()}
    shares = {s: sum(frozenset(map(names, p)) in links for p in found) / n for s, found in pairs.items()}
    print(size, shares)
    assert shares[0.8] >= 0.9 and shares[0.85] >= 0.97 and shares[0.9] >= 0.99


@pytest.mark.parametrize("size", [10**4, 10**7, 10**9, 10**11])
def test_one_lane_misses_nothing(spark, monkeypatch, size):
    """Pairs of up to four different bits, and hot entries dealt out over cells, searched as among that many fingerprints."""
    as_for = simhash.all_segments
    segments = as_for(size, 4)
    assert simhash.work(segments, 10**9) < 10**4 and sum((1 + s.values) / 2 for s in as_for(10**9, 4)) < 60
    monkeypatch.setattr(simhash, "all_segments", lambda n, radius: as_for(size, radius))
    rng = np.random.default_rng(size)
    a = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 6, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    crowd = np.uint64(0xABCD << 40) ^ rng.integers(0, 1 << 20, 400, dtype=np.uint64)
    fps = np.unique(np.r_[a, b, crowd])
    want = brute.near_components([(i, int(f)) for i, f in enumerate(fps)], 4)
    nodes = simhash.checkpoint(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long"))
    at = {x: i for i, x in enumerate(fps.view(np.int64).tolist())}
    for block in (simhash.BLOCK, 16):
        links = [(at[r["a"]], at[r["b"]]) for r in simhash.near_links(nodes, 4, block=block).collect()]
        got = groups(len(fps), links)
        assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == r) for r in set(want.values()))


def test_components(spark):
    """A hub with most links, a path, repeated links, loops and null ends."""
    from quernel.llm.components import components

    rows = [("h", f"x{i}") for i in range(500)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("q", "r"), ("r", "q"), ("q", "r"), ("s", "s"), (None, "h"), ("z", None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {"h": "h", "q": "q", "r": "q"} | {f"x{i}": "h" for i in range(500)} | {f"p{i:03}": "p000" for i in range(61)}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_only_similar_ones_are_dropped(spark, monkeypatch):
    """Families of templated pages that share some 70% of shingles, chains and copies, against brute force."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts, page = [], words(330)
    for _ in range(60):
        texts.append(" ".join(page + words(70)))
    for _ in range(10):
        chain = words(300)
        for k in range(4):
            texts.append(" ".join(chain[20 * k :] + words(20 * k)))
        texts.append(" ".join(chain).upper())
    texts += ["", None, "a b", "A  b", "lone words"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    sets = {i: shingles(t or "") for i, t in enumerate(texts)}
    root = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = {k: new if v == old else v for k, v in root.items()}
    assert len({root[i] for i in range(60)}) == 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: sorted(x["doc_id"] for x in corpus_pipeline.near(spark, docs, "").collect() if x["doc_id"] is not None)
    got = kept()
    assert set(got) >= set(root.values()) and got.count(3) == 2
    assert set(range(60)) <= set(got)
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, width=5, similarity=0.8, lanes=LANES).collect()}
    assert all(root[i] == root[c] for i, c in found.items() if i is not None) and found[None] == 0
    blocks = simhash.alike_links
    monkeypatch.setattr(simhash, "alike_links", lambda *a: blocks(*a, most=20_000))
    assert kept() == got


def test_similar_against_brute_force():
    r = np.random.default_rng(5)
    sets = []
    for _ in range(300):
        base = sets[r.integers(len(sets))] if sets and r.random() < 0.8 else np.unique(r.integers(0, 1000, 60, dtype=np.uint64))
        sets.append(np.unique(np.r_[base[r.random(len(base)) > 0.08], r.integers(0, 1000, r.integers(1, 7), dtype=np.uint64)]))
    joined = lambda links: {frozenset(x) for x in groups(len(sets), links).values()}
    python = [set(s.tolist()) for s in sets]
    want = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard(python[i], python[j]) >= 0.8]
    got = simhash._similar(sets, 0.8)
    assert all(jaccard(python[i], python[j]) >= 0.8 for i, j in got)
    assert joined(got) == joined(want) and len(got) == len(sets) - len(joined(want))


def groups(n, links):
    root = list(range(n))
    for i, j in links:
        root = [root[j] if x == root[i] else x for x in root]
    return {r: [i for i in range(n) if root[i] == r] for r in root}
