"""Operator 7: near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments, each with a small ball; if the balls' radii and one for each segment sum up to more
than `radius`, two fingerprints within `radius` meet in the ball of one segment at least. Each fingerprint is entered in
a table under each of its segments, and looks there under every value within the ball; matches are verified over all
bits. Any number of segments finds all links; of those the one with the least work is taken: entries, and comparisons of
what meets in an entry. Equal fingerprints are one entry. Links are given out as spanning links only, so a dense group
of m fingerprints gives about m links, not all its pairs. A table entry with very many fingerprints is dealt out over
blocks whose pairs are verified in separate tasks.

Fingerprints may have several lanes of 64 bits, each from its own mixing of the shingles' hashes. A similarity of 0.8 is
a distance of a seventh of all bits, for which no balls of guaranteed success exist. With several lanes, segments of two
to four bytes have balls of one bit, and there are as many segments as find a pair at the stated distance with
probability SEARCH. For wider segments, which larger tables need, these are drawn several times from the same bytes, so
that what is found doesn't depend on the size of the table; the distance over all lanes decides.

Given a similarity instead of a radius, fingerprints only name candidates: within each component of theirs, texts are
compared by the Jaccard similarity of their sets of shingles (as 64-bit hashes), and just the pairs that reach it are
links. A component of very many shingles is dealt out over blocks as above.

Defined results: a null text equals the empty text, whose fingerprint is 0 and is linked like any other. Every input
row has one output row; the representative of a component is its smallest id that isn't null. Empty tables give empty
results. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import checkpoint, map_arrow, mixed, small, text_of, without
from quernel.llm.components import components

BITS = 64
SEED = 42
GOLDEN, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Most fingerprints of one table entry that one task verifies against each other; lookers may be LOOKERS times as many.
BLOCK, LOOKERS = 30_000, 8
#: With several lanes, the share of pairs whose bits differ with the stated probability that meet in some entry.
SEARCH = 0.95
#: Comparisons that cost as much as one table entry, which is shuffled and sorted.
COMPARISONS = 512
#: Pairs of one entry that are compared outright; of more, members are first joined to components.
PAIRS = 1 << 16
#: Most bytes of shingles of one component that one task compares with each other.
SET_BYTES = 1 << 23
#: Pairs that are verified in one step.
STEP = 1 << 21
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _hashes(words: list[bytes], joined: bytes, width: int) -> np.ndarray:
    """The hash of each shingle; joined: the words, of which there is one at least, with a space between."""
    from xxhash import xxh64_digest

    if len(words) <= width:
        digests = xxh64_digest(joined, SEED)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
        ends = [*gaps[width - 1 :].tolist(), len(joined)]
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)])
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def _words(text: bytes) -> tuple[list[bytes], bytes]:
    words = text.translate(LOWER).split()
    return words, b" ".join(words)


def fingerprint(text: bytes, width: int, lanes: int = 1) -> bytes:
    """Eight bytes a lane, the highest bit first. Words are what stands between white space."""
    words, joined = _words(text)
    if not words:
        return bytes(8 * lanes)
    hashes = _hashes(words, joined, width)
    return b"".join(_majority(hashes if k == 0 else mixed(hashes + np.uint64(k * GOLDEN & MASK))) for k in range(lanes))


def _majority(hashes: np.ndarray) -> bytes:
    """A bit is 1 if it is in over half the hashes."""
    bytes_, ones = hashes.byteswap().view(np.uint8).reshape(-1, 8), np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 255 * 128):
        bits = np.unpackbits(bytes_[start : start + 255 * 128], axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if whole < len(bits):
            ones += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _kind(lanes: int) -> T.DataType:
    return T.LongType() if lanes == 1 else T.StructType([T.StructField(f"f{k}", T.LongType()) for k in range(lanes)])


def _column(fps: np.ndarray):
    """Rows of lanes as an Arrow column."""
    import pyarrow as pa

    own = [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(fps.shape[1])]
    return own[0] if len(own) == 1 else pa.StructArray.from_arrays(own, [f"f{k}" for k in range(len(own))])


def _rows(column) -> np.ndarray:
    import pyarrow as pa

    own = column.flatten() if pa.types.is_struct(column.type) else [column]
    return np.stack([x.to_numpy(zero_copy_only=False).view(np.uint64) for x in own], axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, lanes: int = 1, named: bool = False) -> DataFrame:
    """id and fp, the fingerprint as a signed long (or as a struct of lanes), for each row of docs. width: words in a shingle.

    named: also doc, a digest of the words.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("text").to_pylist()
                fps = b"".join([fingerprint(t or b"", width, lanes) for t in texts])
                out = {"id": part.column("id"), "fp": _column(np.frombuffer(fps, ">u8").astype(np.uint64).reshape(-1, lanes))}
                if named:
                    out["doc"] = pa.array([_name(t or b"") for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    slim = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    fields = [T.StructField("id", slim.schema["id"].dataType), T.StructField("fp", _kind(lanes)), T.StructField("doc", T.BinaryType())]
    return map_arrow(slim, run, T.StructType(fields if named else fields[:2]))


def _name(text: bytes) -> bytes:
    """The name of all texts of these words."""
    from xxhash import xxh128_digest

    return xxh128_digest(_words(text)[1], SEED)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """doc and shingles, their distinct hashes as bytes, for each row's text that has words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                texts = [t for t in batch.slice(start, 256).column("text").to_pylist() if t.split()]
                sets = [np.unique(_hashes(*_words(t), width)).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([_name(t) for t in texts], pa.binary()), pa.array(sets, pa.binary())], ["doc", "shingles"])

    return map_arrow(texts, run, "doc binary, shingles binary")


class Segment(NamedTuple):
    """Pieces (lane, lowest bit, width) whose bits make up a table key, and the radius of the ball around it."""

    pieces: tuple[tuple[int, int, int], ...]
    ball: int

    @property
    def width(self) -> int:
        return sum(w for _, _, w in self.pieces)

    @property
    def values(self) -> int:
        return sum(math.comb(self.width, r) for r in range(self.ball + 1))


def work(segments: list[Segment], n: int) -> float:
    """Entries of a fingerprint, and comparisons among n of them that are spread evenly, in entries.

    Of two values in a ball the larger is looked for, so that half the ball is entries.
    """
    return sum((1 + s.values) / 2 + s.values * n / 2.0**s.width / COMPARISONS for s in segments)


def cut(count: int, radius: int) -> list[Segment]:
    """Segments of one lane, with balls that together miss no pair within radius; those that need no ball are left out."""
    edges = [round(i * BITS / count) for i in range(count + 1)]
    balls = [(radius + 1) // count - (i >= (radius + 1) % count) for i in range(count)]
    return [Segment(((0, low, high - low),), ball) for (low, high), ball in zip(itertools.pairwise(edges), balls, strict=True) if ball >= 0]


def n_segments(n: int, radius: int) -> int:
    """As many segments as take the least work."""
    return min(range(2, max(2, radius + 1) + 1), key=lambda count: work(cut(count, radius), n))


def all_segments(n: int, radius: int) -> list[Segment]:
    """Segments of one lane that miss no pair within radius."""
    return cut(n_segments(n, radius), radius)


def lane_segments(n: int, share: float, lanes: int) -> list[Segment]:
    """Segments with balls of one bit in which a pair meets with probability SEARCH, if each bit differs with probability share."""
    bits = BITS * lanes
    apart = [math.comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in range(bits + 1)]

    def enough(width: int) -> int:
        apart_by = [(p, (math.comb(bits - d, width) + d * math.comb(bits - d, width - 1)) / math.comb(bits, width)) for d, p in enumerate(apart)]
        return next(count for count in itertools.count(1) if sum(p * (1 - (1 - meets) ** count) for p, meets in apart_by) >= SEARCH)

    def drawn(size: int) -> list[Segment]:
        count, order, out = enough(8 * size), list(range(8 * lanes)), []
        for again in itertools.count(1):
            out += [Segment(tuple((b // 8, b % 8 * 8, 8) for b in order[i : i + size]), 1) for i in range(0, len(order) - size + 1, size)]
            if len(out) >= count:
                return out[:count]
            order = random.Random(again).sample(order, len(order))

    return min((drawn(size) for size in (2, 3, 4)), key=lambda s: work(s, n))


def entries(nodes: DataFrame, segments: list[Segment], lanes: int = 1) -> DataFrame:
    """key, fp, member: fingerprints under their own segments (members), and where they look for larger values.

    Of two values in a ball one is larger, so each pair is found once, by the smaller.
    """

    def of(k: int, segment: Segment) -> Column:
        own, at = F.lit(0).cast("long"), 0
        for lane, low, width in segment.pieces:
            piece = F.shiftrightunsigned("fp" if lanes == 1 else f"fp.f{lane}", low).bitwiseAND((1 << width) - 1)
            own, at = own.bitwiseOR(F.shiftleft(piece, at)), at + width
        masks = [sum(1 << b for b in bits) for r in range(1, segment.ball + 1) for bits in itertools.combinations(range(segment.width), r)]
        entry = lambda value, member: F.struct(value.bitwiseOR(F.lit(k << 40)).alias("key"), F.lit(member).alias("member"))
        around = F.transform(F.lit(masks).cast("array<bigint>") if masks else F.array().cast("array<bigint>"), lambda m: own.bitwiseXOR(m))
        return F.concat(F.array(entry(own, True)), F.transform(F.filter(around, lambda v: v > own), lambda v: entry(v, False)))

    return nodes.select("fp", F.explode(F.concat(*[of(k, s) for k, s in enumerate(segments)])).alias("e")).select("e.key", "fp", "e.member")


class _Forest:
    """Links that join what weren't joined yet."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def spanning(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The places of the links between rows of a and b that join something."""
        names = lambda x: x[:, 0].tolist() if x.shape[1] == 1 else np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel().tolist()
        out = []
        for i, (x, y) in enumerate(zip(names(a), names(b), strict=True)):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.parent[p] = q
                out.append(i)
        return out


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint16) <= radius


def _dense(fps: np.ndarray, member: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of a large entry: members among each other, then each looker with each component of members."""
    own, lookers = fps[member], fps[~member]
    rest, label = np.arange(len(own)), np.full(len(own), -1)
    for seed in range(len(own)):
        if label[seed] >= 0:
            continue
        label[seed], stack = seed, [seed]
        rest = rest[rest != seed]
        while stack and len(rest):
            x = stack.pop()
            near = _near(own[rest], own[x], radius)
            if near.any():
                found, rest = rest[near], rest[~near]
                label[found] = seed
                stack += found.tolist()
                yield np.repeat(own[x : x + 1], len(found), axis=0), own[found]
    step = max(1, STEP // max(1, own.size))
    for start in range(0, len(lookers), step):
        part = lookers[start : start + step]
        i, j = np.nonzero(_near(part[:, None], own[None, :], radius))
        _, first = np.unique(i * np.int64(len(own)) + label[j], return_index=True)
        yield part[i[first]], own[j[first]]


def _verified(radius: int):
    """Spanning links from rows that are ordered by key and block."""

    def links(key: np.ndarray, fp: np.ndarray, member: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes, members = np.diff(np.r_[starts, len(key)]), np.add.reduceat(member.astype(np.int64), starts)
        forest = _Forest()
        pairs = np.where(sizes > 1, sizes * members, 0)
        for g in np.flatnonzero(pairs > PAIRS):
            s = slice(starts[g], starts[g] + sizes[g])
            for a, b in _dense(fp[s], member[s], radius):
                on = forest.spanning(a, b)
                yield a[on], b[on]
        few = np.flatnonzero((pairs > 0) & (pairs <= PAIRS))
        total = np.cumsum(pairs[few])
        step = STEP // fp.shape[1]
        for part in np.split(few, np.searchsorted(total, np.arange(step, total[-1] if len(total) else 0, step))):
            if not len(part):
                continue
            n, size = pairs[part], sizes[part]  # every row of an entry with each of its members
            group = np.repeat(np.arange(len(part)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            order = _members(starts[part], size, member)
            first = np.cumsum(members[part]) - members[part]
            a = order[first[group] + place // size[group]]
            b = starts[part][group] + place % size[group]
            other = ~member[b] | (a < b)
            a, b = a[other], b[other]
            near = _near(fp[a], fp[b], radius)
            if near.any():
                a, b = fp[a[near]], fp[b[near]]
                on = forest.spanning(a, b)
                yield a[on], b[on]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[np.ndarray] = []

        def give(key, fp, member):
            for a, b in links(key, fp, member):
                if len(a):
                    yield pa.RecordBatch.from_arrays([_column(a), _column(b)], ["a", "b"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "member"))
            held.append((key, _rows(batch.column("fp")), member.astype(bool)))
            rows += len(key)
            if rows < 500_000:
                continue
            key, fp, member = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.searchsorted(key, key[-1])  # the last entry may go on in the next batch
            if last:
                yield from give(key[:last], fp[:last], member[:last])
            held, rows = [(key[last:], fp[last:], member[last:])], (len(key) - last) if last else 0
        if held:
            yield from give(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _members(starts: np.ndarray, sizes: np.ndarray, member: np.ndarray) -> np.ndarray:
    """The places of the members of many entries, in order."""
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return places[member[places]]


def near_links(nodes: DataFrame, radius: int, block: int = BLOCK, lanes: int = 1, share: float | None = None) -> DataFrame:
    """a and b: links that connect what is within radius. nodes: distinct fp, checkpointed. share: of bits that differ in the pairs to find."""
    n = nodes.count()
    segments = all_segments(n, radius) if lanes == 1 else lane_segments(n, radius / (BITS * lanes) if share is None else share, lanes)
    found = entries(nodes, segments, lanes)
    sizes = found.groupBy("key").agg(F.count_if("member").alias("own"), F.count_if(~F.col("member")).alias("lookers"))
    hot = checkpoint(sizes.where((F.col("own") > block) | (F.col("own") > 0) & (F.col("lookers") > LOOKERS * block)))
    if hot.limit(1).count():
        parts = lambda c, most: F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("int")
        blocks = small(hot.select("key", parts("own", block).alias("n"), parts("lookers", LOOKERS * block).alias("m")))
        own, slice_ = (F.pmod(F.xxhash64("fp"), F.col(c)).cast("int") for c in "nm")
        upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        # cells: pairs of blocks of members, and then each block of members with each part of the lookers
        pairs = F.transform(upto("n"), lambda j: F.least(own, j) * F.col("n") + F.greatest(own, j))
        cell = lambda j, l: F.col("n") * F.col("n") + j * F.col("m") + l
        to = F.when(F.col("n").isNull(), F.array(F.lit(-1))).when(F.col("member"), F.concat(pairs, F.transform(upto("m"), lambda l: cell(own, l)))).otherwise(F.transform(upto("n"), lambda j: cell(j, slice_)))
        found = found.join(blocks, "key", "left").select("key", "fp", "member", F.explode(to).alias("cell"))
        found = found.withColumn("key", F.when(F.col("cell") >= 0, F.xxhash64("key", "cell")).otherwise(F.col("key"))).drop("cell")
    dealt = found.repartition("key").sortWithinPartitions("key")
    return map_arrow(dealt, _verified(radius), T.StructType([T.StructField(c, _kind(lanes)) for c in "ab"]))


def _similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links of sets whose Jaccard similarity is as given, or more.

    With the rarest elements first, two such sets have a common one among the first of both, so others aren't compared.
    """
    sizes = np.array([len(s) for s in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc, starts = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes) - sizes
    ids = ids[np.lexsort((ids, counts[ids], doc))]
    first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    ahead = (np.arange(len(ids)) - starts[doc] < first[doc]) & (counts[ids] > 1)
    by = np.argsort(ids[ahead], kind="stable")
    holders = doc[ahead][by]
    place = np.searchsorted(ids[ahead][by], np.arange(len(counts) + 1))
    mark, left, n_left, out = np.zeros(len(counts), bool), np.ones(len(sets), bool), len(sets), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], stack = False, [seed]
        n_left -= 1
        while stack and n_left:
            x = stack.pop()
            own = ids[starts[x] : starts[x] + sizes[x]]
            hit = np.zeros(len(sets), bool)
            for t in own[: first[x]]:
                hit[holders[place[t] : place[t + 1]]] = True
            hit &= left & (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x]) - 1e-9)
            tried = np.flatnonzero(hit)
            mark[own] = True
            for part in np.split(tried, np.searchsorted(np.cumsum(sizes[tried]), np.arange(STEP, sizes[tried].sum(), STEP))):
                if not len(part):
                    continue
                n = sizes[part]
                begin = np.cumsum(n) - n
                common = np.add.reduceat(mark[ids[np.repeat(starts[part] - begin, n) + np.arange(n.sum())]], begin, dtype=np.int64)
                found = part[common / (n + sizes[x] - common) >= similarity]
                left[found] = False
                n_left -= len(found)
                out += [(x, y) for y in found.tolist()]
                stack += found.tolist()
            mark[own] = False
    return out


def _compared(similarity: float):
    """Spanning links from docs that are ordered by key."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def give(held: list[tuple]) -> Iterator:
            links = _similar([np.frombuffer(s, np.uint64) for _, s in held], similarity) if len(held) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([held[link[i]][0] for link in links], pa.binary()) for i in (0, 1)], ["a", "b"])

        key, held = None, []
        for batch in batches:
            for k, doc, shingles in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "shingles")), strict=True):
                if k != key:
                    yield from give(held)
                    key, held = k, []
                held.append((doc, shingles))
        yield from give(held)

    return run


def alike_links(texts: DataFrame, members: DataFrame, width: int, similarity: float, most: int = SET_BYTES) -> DataFrame:
    """a and b, docs: links that connect what is similar enough and has the same key. texts: text; members: doc and key, checkpointed."""
    sets = checkpoint(shingle_sets(texts, width).dropDuplicates(["doc"]).join(small(members), "doc").select("key", "doc", "shingles"))
    size = sets.groupBy("key").agg(F.sum(F.octet_length("shingles")).alias("size")).where(F.col("size") > most)
    hot = checkpoint(size.select("key", F.ceil(F.col("size") / most).cast("int").alias("n")))
    if hot.limit(1).count():
        own, every = F.pmod(F.xxhash64("doc"), F.col("n")).cast("int"), F.sequence(F.lit(0), F.col("n") - 1)
        to = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.transform(every, lambda j: F.least(own, j) * F.col("n") + F.greatest(own, j)))
        sets = sets.join(small(hot), "key", "left").select("key", "doc", "shingles", F.explode(to).alias("block"))
        sets = sets.withColumn("key", F.when(F.col("block") > 0, F.xxhash64("key", "block")).otherwise(F.col("key"))).drop("block")
    dealt = sets.repartition("key").sortWithinPartitions("key")
    return map_arrow(dealt, _compared(similarity), "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int | None = None, lanes: int = 1, similarity: float = 0.8, slack: float = 2.0) -> DataFrame:
    """id_col, fingerprint (16 hex digits a lane) and component_id, the smallest id reachable over links of at most radius bits.

    Without a radius, links are pairs of a Jaccard similarity of `similarity` and more among the candidates. These are
    reachable over the distance at which sets of shingles of that similarity are expected, and `slack` standard errors
    more, or half the pairs of just that similarity would be missed.
    """
    exact, share = radius is None, None
    if exact:
        share = math.acos(2 * similarity / (1 + similarity)) / math.pi
        radius = round(BITS * lanes * share + slack * math.sqrt(BITS * lanes * share * (1 - share)))
    fps = checkpoint(fingerprints(docs, id_col, text_col, width, lanes, named=exact))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(nodes.select("fp"), radius, lanes=lanes, share=share))
    own = checkpoint(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # checkpointed, the shorter sides have no partitioning of their own: these are joins whose hot keys Spark splits
    node = "doc" if exact else "fp"
    if exact:
        nodes = checkpoint(fps.groupBy("doc", "fp").agg(F.min("id").alias("least")))
        grouped = checkpoint(nodes.join(small(own.select("fp", F.xxhash64("root").alias("key"))), "fp").select("doc", "least", "key"))
        shared = small(checkpoint(grouped.groupBy("key").count().where("count > 1").select("key")))
        members = checkpoint(grouped.join(shared, "key"))
        sought = small(checkpoint(members.select(F.col("least").alias("_least")).distinct()))
        texts = docs.join(sought, docs[id_col].eqNullSafe(sought["_least"]), "left_semi").select(text_of(text_col).cast("binary").alias("text"))
        roots = components(alike_links(texts, members.select("doc", "key"), width, similarity))
        own = checkpoint(grouped.join(small(checkpoint(roots)), F.col("doc") == F.col("node"), "left").select("doc", "least", F.coalesce("root", "doc").alias("root")))
    least = small(checkpoint(own.groupBy("root").agg(F.min("least").alias("component_id"))))
    named = small(checkpoint(own.join(least, "root").select(node, "component_id")))
    parts = ["fp"] if lanes == 1 else [f"fp.f{k}" for k in range(lanes)]
    shown = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in parts])
    return fps.join(named, node).select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kind) -> DataFrame:
    """docs without the rows whose id isn't their component's smallest. Rows of one id go together; a null id names no row, so its rows stay."""
    found = near_duplicates(docs, id_col, text_col, **kind)
    return without(docs, checkpoint(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()), id_col)
