"""Shards, exact dedup, mixing and BPE: laws, hard rows, and the tokenizers library."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

from quernel.llm import bpe, exact_dedup, kd_shards, mixing, queries

SF = "/root/testdata/sf0.001"
#: Repeated rows, ties, nulls, empty and long texts, and columns with clashing names.
ROWS = [(1, "a b"), (1, "a b"), (2, "a b"), (None, "a b"), (3, None), (4, ""), (None, None), (5, "x " * 50_000), (6, "x " * 50_000), (7, "y"), (7, "z"), (7, "z")]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size int, _len int, kept string, taken int, key int"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, "s" if n % 3 else None, None, n, 1, 2, "k", 3, 4) for n, (i, t) in enumerate(ROWS)], SCHEMA)


def checked_shards(rows, texts, n_shards):
    """rows of kd_shards; texts: (doc_id, text)."""
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(n_shards))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_shards(spark, hard):
    texts = [(r["doc_id"], r["text"]) for r in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
    sizes = checked_shards(queries.op1_kd_shards(spark, "/root/testdata/sf0.01").collect(), texts, 16)
    largest = max(len((t or "").encode()) for _, t in texts)
    mean = sum(sizes.values()) / 16
    of = defaultdict(set)
    shards = {r["doc_id"]: r["shard"] for r in queries.op1_kd_shards(spark, "/root/testdata/sf0.01").select("doc_id", "shard").collect()}
    weight = Counter()
    for i, t in texts:
        of[t or ""].add(shards[i])
        weight[t or ""] += len((t or "").encode()) + 1
    assert all(len(of[t]) == 1 for t in of if weight[t] <= mean / kd_shards.WHOLE)  # copies share a shard
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= max(0.1 * mean, 2 * largest)
    for n in (1, 3):
        checked_shards(kd_shards.kd_shards(hard, n_shards=n).collect(), ROWS, n)
    assert kd_shards.kd_shards(hard.limit(0), n_shards=4).count() == 0
    assert len({r["shard"] for r in kd_shards.kd_shards(hard, target_bytes=70_000).collect()}) in (2, 3)


def test_exact_dedup_hard(spark, hard):
    rows = exact_dedup.exact_dedup(hard).collect()
    groups = Counter(t or "" for _, t in ROWS)
    keep = {g: max((i for i, t in ROWS if (t or "") == g and i is not None), default=None) for g in groups}
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == Counter((i, keep[t or ""], groups[t or ""]) for i, t in ROWS)
    assert sorted(r["keep_id"] for r in rows if r["kept"]) == sorted(keep.values()) and all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    left = exact_dedup.drop_exact_duplicates(hard)
    assert left.columns == hard.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == Counter((keep[g], g) for g in groups)
    assert exact_dedup.exact_dedup(hard.limit(0)).count() == exact_dedup.drop_exact_duplicates(hard.limit(0)).count() == 0


def checked_mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total, sizes = sum(r["size"] for r in rows), {}
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    for s in order:
        sizes[s] = sum(r["size"] for r in by[s])
    target, open_, rest = {}, set(order), 1.5 * total
    while True:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / w >= 2 * sizes[s]} if w else set()
        if not full:
            target |= {s: rest * weight[s] / w for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= full
    for s in order:
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, total) for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= len(by[s])


def test_mixing(spark, hard):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once = mixing.mix(docs).collect()
    checked_mix(once)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, once), key=str)
    checked_mix(mixing.mix(hard).collect())
    taken = mixing.take(hard)
    assert taken.columns == hard.columns and {(r["doc_id"], r["text"]) for r in taken.collect()} <= set(ROWS)
    assert mixing.mix(hard.limit(0)).count() == mixing.take(hard.limit(0)).count() == 0


def test_bpe(spark, hard):
    library = Tokenizer.from_file(bpe.vocabulary())
    texts = [d["text"] for d in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()]
    texts += [None, "", " ", "İstanbul ΣΑΣ ς", "x<|endoftext|>y <|startoftext|><|endoftext", " a b\u0085c\u001cd​e", "it's we'll 1234 ½²³ ＡＢ ﬁ ñ é", "日本語 テキスト 🙂👨‍👩‍👧", "\x00\x01 ﻿ a", "a" * 3000, "!?" * 2000, "ǅ ß ẞ K Å ª º µ", "é å"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    encoded = bpe.encode(docs)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert ids[i] == want and decoded[i] == text
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(want), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip(hard).count() == len(ROWS) and bpe.encode(hard.limit(0)).count() == 0
