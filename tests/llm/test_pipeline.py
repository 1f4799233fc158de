"""The pipeline, stage by stage, against plain versions."""

import hashlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pyarrow.dataset as ds
from tokenizers import Tokenizer

from quernel.llm import bpe, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = {"documents": {d["doc_id"]: d["text"] or "" for d in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()}}
    rows = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        if i < 4:
            assert docs.columns == names
            seen[name] = {r["doc_id"]: r["text"] or "" for r in rows[name]}
    before, rules, exact, near, mix = seen["documents"], seen["quality_rules"], seen["exact_dedup"], seen["near_dedup"], seen["mixing"]
    for i, t in before.items():
        w = brute.words(t)
        if len(w) < 20 or 100 * brute.repeat_words(w) > 30 * len(w):
            assert i not in rules
    assert len(rules) > 0.5 * len(before)
    assert exact == {max(i for i, u in rules.items() if u == t): t for t in set(rules.values())}

    # who goes has a nearer one that stays, over links within the radius; who stays is alone in its component
    fps = {i: np.frombuffer(simhash.fingerprint(t.encode(), 5, corpus_pipeline.LANES), np.uint64) for i, t in exact.items()}
    ids, matrix = list(fps), np.stack(list(fps.values()))
    linked = {i: {ids[j] for j in np.flatnonzero(simhash._near(matrix, fps[i], 39))} for i in ids}
    assert all(any(j in linked[i] for j in exact if j != i) for i in exact.keys() - near.keys())
    sets = {i: set(zip(*[brute.words(t.lower())[k:] for k in range(5)])) for i, t in exact.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert not [(a, b) for a in near for b in near if a < b and alike(a, b) >= 0.9]
    assert all(max(alike(i, j) for j in exact if j != i) > 0.5 for i in exact.keys() - near.keys())

    copies = Counter(r["doc_id"] for r in rows["mixing"])
    assert set(copies) <= set(near) and max(copies.values()) <= 2 and all(mix[i] == near[i] for i in mix)
    words = sum(len(brute.words(t)) for t in near.values())
    assert abs(sum(n * len(brute.words(near[i])) for i, n in copies.items()) - 1.5 * words) < 0.2 * words
    assert Counter(r["doc_id"] for r in rows["bpe"]) == copies
    library = Tokenizer.from_file(bpe.vocabulary())
    for r in rows["bpe"]:
        want = library.encode(mix[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, rows["bpe"]))
