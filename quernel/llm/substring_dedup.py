"""Operator 5: repeated passages, by seed and extend.

Seeds: the k-grams of words are winnowed, so that every window of `window` words has one anchor among its own k-grams,
chosen by content alone; equal windows have equal anchors at the same place. Windows next to each other that share an
anchor are a run of at most `window - k + 1`.

Extend: the context of a seed is hashed both ways as far as its run's windows reach. Runs of equal anchor and equal
context are repeated over their whole length, so the interior of any repeat is settled at once; only where contexts of
one anchor differ, at the ends of repeats, are the single windows of one run of each context compared. Neighbouring
repeated windows grow together into maximal repeats. No pairs are built: equal keys meet by sorting, a task first
settles what repeats within its own batch and hands on one row of it, and the sorted rows are read as a stream of which
two rows are held, so one anchor in a third of all texts is no unbounded group.

Two hashes of 64 bits each must agree before words are removed: a sum of powers for the anchor, and for the context a
hash by doubling, over another hash of the words.

Defined results: a null or empty text has no words. Words are judged on the input, not on what is left; a repeated row
counts as another place. Rows are told apart by 88 bits of their id and text; those that share both are treated alike. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_intdigest

from quernel.llm.common import checkpoint, map_arrow, mixed, text_of

WINDOW = 35
#: Bytes that are cut into words in one step, to the next separator.
PIECE = 1 << 22
#: Bits of a second hash of the text, which with the first tells rows apart, of a run's length and of its first word's place.
TEXT_BITS, RUN_BITS, PLACE_BITS = 24, 8, 31
U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True


#: Odd factors of the two hashes, and the bytes beyond which a word is hashed by itself.
FACTORS, LONG = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)), 64


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


OF_WORDS = _Powers(0xA0761D6478BD642F)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap = SEPARATOR[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    return edge[::2], edge[1::2]


def hashed(piece: bytes, begin: np.ndarray, stop: np.ndarray, hashes: int = 2) -> list[np.ndarray]:
    """The first hash or both of the words between begin and stop: chains over eight bytes at a time, or XXH3 of a long word."""
    eights = np.ndarray(len(piece) + 1, "<u8", piece + bytes(8), strides=(1,))  # the eight bytes from each place on
    sizes = stop - begin
    out = [mixed(sizes.astype(U) * f) for f in FACTORS[:hashes]]
    for at in range(0, min(LONG, int(sizes.max())), 8):
        live = np.flatnonzero(sizes > at)
        left = np.minimum(sizes[live] - at, 8).astype(U)
        value = eights[begin[live] + at] & (U(2**64 - 1) >> (U(64) - left * U(8)))
        out[0][live] = mixed((out[0][live] ^ value) * FACTORS[0])
        if hashes > 1:
            out[1][live] = mixed(out[1][live] + value * FACTORS[1])
    for i in np.flatnonzero(sizes > LONG).tolist():
        whole = xxh3_128_intdigest(piece[begin[i] : stop[i]])
        for x, part in zip(out, (whole >> 64, whole & (2**64 - 1)), strict=False):
            x[i] = part
    return out


def word_hashes(text: bytes, hashes: int = 2) -> tuple[np.ndarray, ...]:
    """Two hashes of 64 bits of each word, or the first alone."""
    out, start = [], 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            while end < len(text) and not SEPARATOR[text[end]]:
                end += 1
        piece = text[start:end]
        start = end
        begin, stop = word_spans(piece)
        if len(begin):
            out.append(hashed(piece, begin, stop, hashes))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, U),) * hashes


class _Sums:
    """Hashes of all runs of words of one text, as sums of powers."""

    def __init__(self, words: np.ndarray):
        up, self.down = OF_WORDS.to(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(words * up[:-1], dtype=U)])

    def of(self, first: np.ndarray, size) -> np.ndarray:
        return mixed((self.sums[first + size] - self.sums[first]) * self.down[first])


class _Doubled:
    """Hashes of all runs of at most `most` words, by doubling: of 2**j words from both halves, of others from the two such runs that cover them."""

    def __init__(self, words: np.ndarray, most: int):
        self.levels, size = [words], 1
        while 2 * size <= min(most, len(words)):
            x = self.levels[-1]
            self.levels.append(self._both(x[:-size], x[size:]))
            size *= 2

    @staticmethod
    def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(a * FACTORS[0] + mixed(b + FACTORS[1]))

    def of(self, first: np.ndarray, size) -> np.ndarray:
        size = np.broadcast_to(np.asarray(size, np.int64), first.shape)
        level = np.frexp(size)[1] - 1
        out = np.empty(len(first), U)
        for j in np.unique(level).tolist():
            i = level == j
            out[i] = self._both(self.levels[j][first[i]], self.levels[j][first[i] + size[i] - (1 << j)]) ^ mixed(size[i].astype(U))
        return out


def anchors(both: tuple[np.ndarray, np.ndarray], window: int) -> tuple[np.ndarray, ...] | None:
    """Of each run of windows that share an anchor: its first window, its length, the anchor's hash, the context's hash."""
    words, others = both
    n = len(words) - window + 1
    if n < 1:
        return None
    k = max(1, window // 2)
    grams = _Sums(words).of(np.arange(len(words) - k + 1), k)
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    size = np.diff(np.r_[first, n])
    context = _Doubled(others, 2 * window).of(first, size + (window - 1)) ^ mixed(((at[first] - first) * 1024 + size).astype(U))
    return first, size, grams[at[first]], context


def _packed(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return text << (RUN_BITS + PLACE_BITS) | first << RUN_BITS | size


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether a row equals the one before it."""
    out = np.ones(len(columns[0]), bool)
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    out[:1] = False
    return out


def _settled(parts: list[tuple], rows: np.ndarray) -> Iterator:
    """A batch with what repeats within it marked: twice says that a run was found again, dealt where its row goes.

    Of rows of equal key and context one goes on under its key; all are given out as repeated, dealt out by chance.
    """
    import pyarrow as pa

    row, key, context, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((context, key))
    row, key, context, place = (x[order] for x in (row, key, context, place))
    again = _same(key, context)
    twice = again | np.r_[again[1:], False]
    on = ~again
    found = lambda x, chosen: x[chosen].view(np.int64)
    settled = np.flatnonzero(twice)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(rows[np.r_[row[on], row[settled]]]),
            pa.array(np.r_[found(key, on), mixed(place[settled].astype(U) + row[settled].astype(U)).view(np.int64)]),
            pa.array(np.r_[found(context, on), np.zeros(len(settled), np.int64)]),
            pa.array(np.r_[place[on], place[settled]]),
            pa.array(np.r_[np.where(twice[on], 1, 0), np.full(len(settled), 2)].astype(np.int8)),
        ],
        ["row", "key", "context", "place", "state"],
    )


#: state: 0 a run, 1 a run whose task has given it out as repeated, 2 a run that is given out as repeated.
RUNS = "row long, key long, context long, place long, state byte"


def _seeded(window: int):
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            parts = []
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            for i in range(batch.num_rows):
                if (found := anchors(word_hashes(texts[i].as_py()), window)) is not None:
                    first, size, key, context = found
                    parts.append((np.full(len(first), i), key, context, _packed(tags[i], first, size)))
            if parts:
                yield from _settled(parts, batch.column("row").to_numpy(zero_copy_only=False))

    return run


def _extended(window: int):
    """The single windows of the runs in places, with their own hashes as contexts."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            parts = []
            places, keys, texts = batch.column("places"), batch.column("keys"), batch.column("text")
            for i in range(batch.num_rows):
                at, key = (np.array(x[i].as_py(), np.int64) for x in (places, keys))
                size, first = at & ((1 << RUN_BITS) - 1), at >> RUN_BITS & ((1 << PLACE_BITS) - 1)
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = np.repeat(first, size) + step
                context = _Doubled(word_hashes(texts[i].as_py())[1], window).of(start, window)
                parts.append((np.full(len(start), i), np.repeat(key, size).view(U), context, _packed(np.repeat(at >> (RUN_BITS + PLACE_BITS), size), start, np.ones(len(start), np.int64))))
            if parts:
                yield from _settled(parts, batch.column("row").to_numpy(zero_copy_only=False))

    return run


def _met(ends: bool):
    """From rows in order of key and context: those that repeat (open false) and, if ends, one run of each context whose anchor has others (open true).

    Of the rows read so far, the first of the last context is held back.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, others = None, False  # others: whether an earlier context of the held row's key was seen

        def give(rows, last: bool):
            nonlocal held, others
            key, context, state = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "context", "state"))
            plain = state != 2
            out_ids = [np.flatnonzero(~plain)]
            live = np.flatnonzero(plain)
            opened = np.zeros(0, np.int64)
            if len(live):
                k, c, s = key[live], context[live], state[live]
                again = _same(k, c)
                group = np.flatnonzero(~again)
                size = np.diff(np.r_[group, len(live)])
                many = np.repeat(size > 1, size)
                before = _same(k[group])
                before[0] = before[0] or (others and held is not None)
                after = np.r_[before[1:], False]
                repeated = (many | (s == 1)) & (s != 1) & (s != 3)  # what is in state 1 or 3 has been given out
                final = np.ones(len(group), bool)
                if not last:
                    final[-1] = False
                    hold = live[group[-1]]
                    value = 3 if size[-1] > 1 or s[group[-1]] in (1, 3) else 0
                    held = rows.slice(hold, 1).set_column(rows.schema.get_field_index("state"), "state", pa.array([value], pa.int8()))
                    others = bool(before[-1])
                    if size[-1] == 1:
                        repeated[group[-1]] = False
                out_ids.append(live[repeated])
                if ends:
                    opened = live[group[final & (before | after)]]
            rows_out = np.concatenate([*out_ids, opened])
            if len(rows_out):
                taken = rows.take(pa.array(rows_out))
                yield pa.RecordBatch.from_arrays([taken.column("row"), taken.column("key"), taken.column("place"), pa.array(np.r_[np.zeros(len(rows_out) - len(opened), bool), np.ones(len(opened), bool)])], ["row", "key", "place", "open"])

        for batch in batches:
            if batch.num_rows:
                rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                yield from give(rows, False)
        if held is not None:
            yield from give(held, True)

    return run


def _meet(runs: DataFrame, ends: bool) -> DataFrame:
    """Rows of equal keys and contexts meet by sorting; for ends, all contexts of a key do."""
    dealt = runs.repartition(*["key", "context"][: 1 if ends else 2]).sortWithinPartitions("key", "context")
    return map_arrow(dealt, _met(ends), "row long, key long, place long, open boolean")


def _by_text(runs: DataFrame, *lists: str) -> DataFrame:
    """Rows of one text together; a text's runs are fewer than its words."""
    tag = F.shiftright("place", RUN_BITS + PLACE_BITS).alias("_tag")
    return runs.groupBy(F.col("row").alias("_row"), tag).agg(F.collect_list("place").alias("places"), *[F.collect_list(c).alias(c + "s") for c in lists])


def _removed(window: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, kept = [], [], []
            places, texts = batch.column("places"), batch.column("text")
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if (at := places[i].as_py()) is None:
                    words = text.split()
                    n_words.append(len(words))
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                at = np.array(at, np.int64)
                first, size = at >> RUN_BITS & ((1 << PLACE_BITS) - 1), at & ((1 << RUN_BITS) - 1)
                begin, end = word_spans(text)
                depth = np.zeros(len(begin) + 1, np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + size + (window - 1), -1)
                rest = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                n_words.append(len(begin))
                n_removed.append(len(begin) - len(rest))
                kept.append(b" ".join([text[a:b] for a, b in zip(begin[rest].tolist(), end[rest].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col, n_words, n_removed and text, the words that are kept, joined by a space, for each row of docs."""
    text = text_of(text_col)
    tag = F.crc32(text.cast("binary")).bitwiseAND((1 << TEXT_BITS) - 1)
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("row"), tag.alias("tag"), text.cast("binary").alias("text"))
    kind = own.schema["id"].dataType
    met = checkpoint(_meet(map_arrow(own, _seeded(window), RUNS), True))

    # both joins take the same columns of own, so that its texts are dealt out once and read twice
    ends = _by_text(met.where("open"), "key").hint("shuffle_hash")
    at = (own["row"] == ends["_row"]) & (own["tag"] == ends["_tag"])
    windows = map_arrow(own.join(ends, at).select("id", "row", "text", "places", "keys"), _extended(window), RUNS)
    more = _meet(windows, False)

    found = _by_text(met.where("not open").select("row", "place").union(more.select("row", "place"))).hint("shuffle_hash")
    at = (own["row"] == found["_row"]) & (own["tag"] == found["_tag"])
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])
    out = map_arrow(own.join(found, at, "left").select("id", "text", "places"), _removed(window), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("text"))


#: What op5_substring_dedup returns, as DuckDB SQL over all windows; ids are distinct there.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (SELECT doc_id, list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' '))) AS h FROM d WHERE len(w) >= 35),
placed AS (SELECT doc_id, unnest(h) AS x, unnest(range(1, len(h) + 1)) AS i FROM hashed),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM placed WHERE x IN (SELECT x FROM placed GROUP BY x HAVING count(*) > 1)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
