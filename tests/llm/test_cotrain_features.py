"""Features of many texts at once, against a plain version."""

import random

import numpy as np
import pyarrow as pa

from quernel.llm import cotrain, substring_dedup


def _plain(text):
    out = np.zeros(cotrain.TEXT_SIZE, np.float32)
    out[-1] = 1
    if not text:
        return out
    kinds = np.bincount(cotrain.BYTE_KIND[np.frombuffer(text, np.uint8)], minlength=cotrain.N_KINDS)
    out[cotrain.HASHED : cotrain.HASHED + cotrain.N_KINDS] = np.sqrt(kinds / len(text))
    words = [int(substring_dedup.word_hashes(w)[0][0]) for w in text.split()]
    if n := len(words):
        out[: cotrain.HASHED] = np.sqrt(np.bincount([w % cotrain.HASHED for w in words], minlength=cotrain.HASHED)) / np.sqrt(n)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[-5:-1] = len(set(words)) / n, np.log1p(n) / 10, again / max(1, n - 1), min(1, len(text) / n / 20)
    return out


def _texts():
    r = random.Random(3)
    words = [b"a", b"bb", b"seven77", b"eight888", b"nine99999", "é\xa0ü".encode(), b"x" * 64, b"y" * 65, b"\x00", b"#"]
    many = [r.choice((b"", b" ", b"\n")) + b" ".join(r.choice(words) for _ in range(r.choice((0, 1, 2, 40)))) + r.choice((b"", b"\t")) for _ in range(256)]
    return [b"", *many, b" ", b"z" * 3000 + b" b b", b"long text " * 200, b"", b"a", b"a"]


def _batch(texts):
    n = len(texts)
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary()), "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [1.0] * n})


def test_features_of_many_texts(monkeypatch):
    texts = _texts()
    want = np.stack([_plain(t) for t in texts])
    for group in (1, 500, 1 << 19):
        monkeypatch.setattr(cotrain, "GROUP", group, raising=False)
        assert np.array_equal(cotrain._features(_batch(texts))[0], want)
    assert cotrain.texts_features([]).shape == (0, cotrain.TEXT_SIZE)


def test_texts_are_hashed_together(monkeypatch):
    """Steps of hashing don't grow with the number of short texts."""
    calls, mixed = [], substring_dedup.mixed
    monkeypatch.setattr(substring_dedup, "mixed", lambda x: calls.append(1) or mixed(x))
    cotrain._features(_batch([b"some words %d" % i for i in range(256)]))
    assert len(calls) < 10
