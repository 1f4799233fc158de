"""Operator 9: BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf holds the rank of the pair that begins at one symbol; each inner node holds the least (rank, place) below it.
The root yields the leftmost merge of lowest rank; a merge changes two pairs and removes one, three point updates of
logarithmic cost, until the root holds no mergeable pair. The library's own normalizer and pre-tokenizer split a text;
merging, the lookup of ids and decoding are done here. Whole texts are encoded; a worker remembers a bounded number of
words, so memory doesn't grow with the corpus.

Defined results: a null or empty text has no ids and decodes to the empty text. Rows are handled one by one, so ties,
repeated rows and extra columns change nothing; only the columns that are asked for are read. Null ids stay null.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import map_arrow, text_of

#: A leaf is rank << PLACE_BITS | place, so that one comparison finds the leftmost of the lowest rank.
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1
NONE = 1 << 80
#: Runs without white space whose ids a worker remembers in each of two generations.
MEMORY = 150_000
LONGEST_REMEMBERED = 48
#: Rows in a batch that goes through Python at once.
BATCH_ROWS = 256
#: Outside these characters (ASCII and the printable rest of Latin-1, which NFC leaves as they are) the library's normalizer and pre-tokenizer are used.
UNUSUAL = re.compile("[^\t-\r -~\u00a1-\u00ff]")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is printable, else the next letter from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


BYTE_LETTERS = byte_letters()


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge symbols, in place, until no pair is left; the symbols that remain.

    ranks: a << 20 | b of each mergeable pair to its rank << PLACE_BITS; merged: by rank, the symbol that a pair becomes.
    tree[1] is the root, tree[width + i] the pair that begins at symbol i, or NONE.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get, width = ranks.get, 1 << (n - 2).bit_length()
    tree = [NONE] * (2 * width)
    a = symbols[0]
    for i in range(1, n):
        b = symbols[i]
        r = get(a << 20 | b)
        if r is not None:
            tree[width + i - 1] = r | (i - 1)
        a = b
    for x in range(width - 1, 0, -1):
        a, b = tree[2 * x], tree[2 * x + 1]
        tree[x] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < NONE:
        i = root & PLACE
        j = after[i]
        symbols[i] = s = merged[root >> PLACE_BITS]
        symbols[j] = -1
        after[i] = k = after[j]
        r = None
        if k < n:
            before[k] = i
            r = get(s << 20 | symbols[k])
        y = width + i
        tree[y] = NONE if r is None else r | i
        x = z = y
        if j < n - 1:
            z = width + j
            tree[z] = NONE
        if (p := before[i]) >= 0:
            x = width + p
            r = get(symbols[p] << 20 | s)
            tree[x] = NONE if r is None else r | p
        while z > 1:  # the paths from the three leaves to the root, together where they have met
            x, y, z = x >> 1, y >> 1, z >> 1
            a, b = tree[2 * y], tree[2 * y + 1]
            tree[y] = a if a <= b else b
            if x != y:
                a, b = tree[2 * x], tree[2 * x + 1]
                tree[x] = a if a <= b else b
            if z != y:
                a, b = tree[2 * z], tree[2 * z + 1]
                tree[z] = a if a <= b else b
    return [s for s in symbols if s >= 0]


class Memory(dict):
    """The ids of recent chunks, in two generations of a bounded size."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.compute(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


class Bpe:
    """The model of a tokenizer file of kind BPE with an optional suffix of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks, self.merged = {}, []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 20 | self.vocab[b]] = len(self.merged) << PLACE_BITS
            self.merged.append(self.vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.tokens = {v: k for k, v in (self.vocab | self.special).items()}
        self.initial, self.final = ({letter: self.vocab.get(letter + x) for letter in BYTE_LETTERS.values()} for x in ("", self.suffix))
        self.known = Memory(self.chunk)

    def word(self, piece: str) -> list[int]:
        """The ids of one pre-token in byte letters; symbols that the vocabulary doesn't have are left out."""
        symbols = [*map(self.initial.get, piece[:-1]), self.final.get(piece[-1])]
        return merge([s for s in symbols if s is not None] if None in symbols else symbols, self.ranks, self.merged)

    def chunk(self, chunk: str) -> bytes:
        """The ids of a normalized run without white space, as little-endian unsigned 32-bit integers."""
        if UNUSUAL.search(chunk):
            pieces = [piece for piece, _ in self.splitter.pre_tokenize_str(chunk)]
        else:
            pieces = PIECE.findall(chunk)
            if len(pieces) > 1:
                return b"".join(map(self.known.__getitem__, pieces))  # each piece by itself is split the same way
            if not chunk.isascii():
                pieces = [x.encode().decode("latin-1").translate(BYTE_LETTERS) for x in pieces]
        return array("I", self.word(pieces[0]) if len(pieces) == 1 else [x for piece in pieces for x in self.word(piece)]).tobytes()

    def encode(self, text: str) -> bytes:
        out, known = [], self.known.__getitem__
        for part in self.special_re.split(text) if self.special_re and "<|" in text else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif UNUSUAL.search(part):
                out += map(known, [x for x in self.normalizer.normalize_str(part).split(" ") if x])
            else:
                out += map(known, part.lower().split())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as a model without a decoder has it; unknown ids are left out."""
        return " ".join([x for x in map(self.tokens.get, array("I", ids)) if x is not None])


@lru_cache(maxsize=2)
def model(path: str) -> Bpe:
    return Bpe(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoded(path: str, keep: str):
    """keep: ids gives the ids, digest what the query returns of ids and decoded texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = model(path)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                own = [part.column("id")]
                if keep == "ids":
                    rows = [array("I", x).tolist() for x in ids]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.list_(pa.int32()))], ["id", "ids"])
                else:
                    decoded = [bpe.decode(x) for x in ids]
                    sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                    yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(x.encode() for x in decoded), pa.array([len(x) for x in decoded], pa.int64())], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

    return run


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids, the token ids of the whole text."""
    slim = _slim(docs, id_col, text_col)
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_arrow(slim, _encoded(path or vocabulary(), "ids"), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text, decoded from ids_col; null ids decode to the empty text."""
    path = path or vocabulary()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = model(path)
        for batch in batches:
            texts = [bpe.decode(array("I", x or []).tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    slim = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("text", T.StringType())])
    return map_arrow(slim, run, schema).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col with counts and digests of the ids and of the text decoded from them, without a second pass."""
    slim = _slim(docs, id_col, text_col)
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType)] + [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("decoded_chars", T.LongType()))])
    return map_arrow(slim, _encoded(path or vocabulary(), "digest"), schema).withColumnRenamed("id", id_col)
