"""Operator 8: personal data, by gradient boosting over candidates.

Strict patterns give the base spans. High-recall generators of the same kinds propose further, overlapping candidates;
each becomes a cell of binary features of format and context. Boosted trees of depth two are trained on the cells: on
the counts of the corpus's candidates that are known to be good (base spans) or bad (a failed checksum or range, or the
context of another number), which are at most two a cell, and on a short list of labelled snippets. Other candidates
have no label. At any size of the corpus, neither class of a kind weighs more than the kind's snippets. Scores are calibrated on cells' counts of held-out rows, and a cell is chosen if
its calibrated probability passes the threshold; a chosen candidate that overlaps no base span is added. Everything on
the rows is built-in functions: patterns, cells and the lookup of chosen cells; the driver sees cells only.

Defined results: a null text is the empty text and has no spans. Rows are judged one by one, so ties, repeated rows and
extra columns change nothing. An empty table trains on the snippets alone and gives an empty result. Positions count
code points from 0, ends exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import let, literal_rows, once, text_of

KINDS = ["email", "ip", "card", "phone"]

#: The strict patterns. The guards (not within a run, but where the last match ended) and possessive quantifiers only
#: save attempts that must fail and the recursion of Java's loops over groups: matches are those of the plain patterns,
#: leftmost and not overlapping.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators.
CANDIDATES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[(\[{](?:at|AT)[)\]}])\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[(\[{](?:dot|DOT|\.)[)\]}])\x20?[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:(?:\.|[(\[](?:dot|\.)[)\]])[0-9]++){3,}+",
    "card": r"[0-9](?:[\x20.-]?[0-9])++",
    "phone": r"[+(]?[0-9][\x20().0-9-]{5,}[0-9]",
}
#: What a text holds if it has a match of the kind.
HINTS = {
    "email": (r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", r"@|[(\[{](?:at|AT)[)\]}]"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:\.|[(\[](?:dot|\.)[)\]])[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20.-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"[0-9][\x20().0-9-]{5,}[0-9]"),
}
FEATURES = ["email", "ip", "card", "phone", "in_range", "checksum", "plus", "grouped", "veiled", "asked_for", "other_number", "apart"]
ASKED_FOR = {
    "email": r"(?i)(?:e-?mail|contact|write to|reach|mailto|address)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip|host|server|address|from|ping)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|pay)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|sms|whatsapp|dial)\W*(?:\w+\W+)?$",
}
OTHER_NUMBER = r"(?i)(?:order|invoice|version|isbn|issn|serial|ref|item|sku|total|page|doi|id|no|v)\W{0,3}$|[$€£]\W?$"

#: Labelled snippets: (text before, candidate, kind, whether it is personal data). Invented.
SNIPPETS = [
    ("email me: ", "ann.lee [at] mail [dot] example", "email", 1), ("contact ", "bo(at)example(dot)org", "email", 1), ("write to ", "c_d [at] example.net", "email", 1),
    ("reach me under ", "jo [at] post [dot] example [dot] com", "email", 1), ("see ", "figure (at) scale 1.5", "email", 0), ("prices ", "@ 3.50", "email", 0), ("run ", "pkg @ 1.2", "email", 0),
    ("call ", "(555) 555-0142", "phone", 1), ("phone: ", "555-555-0117", "phone", 1), ("tel ", "020 7946 0958", "phone", 1), ("mobile ", "0151 555 01234", "phone", 1), ("fax: ", "555.555.0199", "phone", 1),
    ("order no. ", "5550 1234 11", "phone", 0), ("version ", "2024.01.15", "phone", 0), ("isbn ", "978-3-16-148410-0", "phone", 0), ("in ", "1990 - 2015", "phone", 0), ("the years ", "1914-1918", "phone", 0), ("total ", "12 345 678", "phone", 0), ("of ", "100 000 000", "phone", 0), ("id ", "00412345678", "phone", 0),
    ("from ", "192[.]0[.]2[.]44", "ip", 1), ("host ", "198[.]51[.]100[.]7", "ip", 1), ("server ", "203(.)0(.)113(.)9", "ip", 1), ("version ", "10.4.2.1.7", "ip", 0), ("section ", "1.2.3.4.5", "ip", 0), ("v", "300.400.500.600", "ip", 0),
    ("card ", "3714 496353 98431", "card", 1), ("credit card: ", "378282246310005", "card", 1), ("visa ", "4222222222222", "card", 1), ("pay with ", "5105.1051.0510.5100", "card", 1), ("order ", "378282246310006", "card", 0), ("serial ", "123456789012", "card", 0), ("", "1234567890123456", "card", 0), ("ref ", "4000 1234 5678 9999", "card", 0), ("id ", "0000000000000", "card", 0),
]
ROUNDS, RATE = 60, 0.3
#: A cell is chosen at this calibrated probability.
THRESHOLD = 0.9
#: Spans that are looked through together.
SPANS = 128


def _running(values: Column, start: Column) -> Column:
    """Sums before each value. Appending copies, so this is for short arrays."""
    step = lambda at, x: F.struct((at["at"] + x).alias("at"), F.concat(at["out"], F.array(at["at"])).alias("out"))
    return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda at: at["out"])


def _sums_before(values: Column, block: int = 64) -> Column:
    """Sums before each value, by blocks."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(block)), lambda s: F.slice(v, s + 1, block))
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)
    within = lambda blocks: F.flatten(F.zip_with(blocks, _running(F.transform(blocks, total), F.lit(0)), lambda b, s: _running(b, s)))
    return let(values, lambda v: let(cut(v), within))


NO_SPANS = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """start, end, the match, and what stands before and after it, for each match of a pattern."""

    def placed(between: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda s, i: F.length(s) + F.length(F.get(between, i)))

        def one(start: Column, i: Column) -> Column:
            s, gap = F.get(found, i), F.get(between, i)
            at = start + F.length(gap)
            return F.struct(at.alias("start"), (at + F.length(s)).alias("end"), s.alias("s"), F.right(gap, F.lit(32)).alias("before"), F.left(F.get(between, i + 1), F.lit(1)).alias("after"))

        return F.transform(_sums_before(sizes), one)

    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    whole = let(found, lambda f: F.when(F.size(f) > 0, let(between, lambda b: placed(b, f))).otherwise(F.array().cast(NO_SPANS)))
    return F.when(text.rlike(hint), whole).otherwise(F.array().cast(NO_SPANS))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _bytes(s: Column) -> Column:
    """Whether all numbers in s are at most 255."""
    short = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), lambda p: (F.length(short(p)) < 3) | ((F.length(short(p)) == 3) & (short(p) <= "255")))


def _holds(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    return {"email": F.lit(True), "ip": _bytes(s), "card": F.when(n.between(16, 19), _luhn(_digits(s))).otherwise(False), "phone": n.between(8, 15)}[kind]


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of the strict pattern of a kind."""
    return F.filter(_matches(text, BASE[kind], HINTS[kind][0]), lambda m: _holds(kind, m["s"]))


def _cell(kind: str, m: Column) -> Column:
    """The features of a candidate, as bits of a number."""
    s, digits = m["s"], _digits(m["s"])
    n = F.length(digits)
    in_range = {
        "email": s.rlike(r"[A-Za-z]{2,}$"),
        "ip": _bytes(s) & (F.size(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))) == 4),
        "card": n.between(13, 19),
        "phone": n.between(9, 13),
    }[kind]
    bits = {
        "in_range": in_range,
        "checksum": F.when(n.between(12, 19), _luhn(digits)).otherwise(False) if kind == "card" else F.lit(False),
        "plus": s.startswith("+"),
        "grouped": s.rlike(r"[0-9][\x20().-]+[0-9]"),
        "veiled": s.rlike(r"[(\[{](?:at|AT|dot|DOT|\.)[)\]}]"),
        "asked_for": m["before"].rlike(ASKED_FOR[kind]),
        "other_number": m["before"].rlike(OTHER_NUMBER),
        "apart": ~m["before"].rlike(r"[\w.]$") & ~m["after"].rlike(r"\w"),
    }
    out = F.lit(1 << FEATURES.index(kind))
    for name, bit in bits.items():
        out = out + F.when(bit, 1 << FEATURES.index(name)).otherwise(0)
    return out


def _candidates(text: Column, kind: str, judged: bool = False) -> Column:
    """start, end and cell (judged: also bad) of what the generator of a kind proposes."""
    least = {"email": 0, "ip": 4, "card": 12, "phone": 7}[kind]
    found = F.filter(_matches(text, CANDIDATES[kind], HINTS[kind][1]), lambda m: F.length(_digits(m["s"])).between(least, 19) if least else F.lit(True))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _cell(kind, m).alias("cell"), *([_bad(kind, m).alias("bad")] if judged else [])))


def _bad(kind: str, m: Column) -> Column:
    """Whether a candidate that is no base span surely isn't personal data."""
    n = F.length(_digits(m["s"]))
    failed = {
        "email": ~m["s"].rlike(r"[A-Za-z]{2,}$"),
        "ip": ~_bytes(m["s"]) | (F.size(F.regexp_extract_all(m["s"], F.lit("[0-9]+"), F.lit(0))) != 4),
        "card": ~_luhn(_digits(m["s"])),
        "phone": ~n.between(7, 15),
    }[kind]
    return failed | m["before"].rlike(OTHER_NUMBER)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def _blocks(spans: Column) -> Column:
    """Spans that are in order and don't overlap, by blocks of SPANS, each with its first start and last end."""
    part = lambda s: F.struct(s[0]["start"].alias("start"), F.get(s, F.size(s) - 1)["end"].alias("end"), s.alias("spans"))
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(SPANS)), lambda i: part(F.slice(v, i + 1, SPANS)))
    return let(spans, lambda v: F.when(F.size(v) > 0, parts(v)).otherwise(F.array().cast("array<struct<start:int,end:int,spans:array<struct<start:int,end:int>>>>")))


def _meets(blocks: Column, c: Column, equal: bool = False) -> Column:
    """Whether c overlaps (or equals) a span of the blocks; only blocks that it overlaps are looked into."""
    over = lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
    hit = (lambda b: (b["start"] == c["start"]) & (b["end"] == c["end"])) if equal else over
    return F.exists(blocks, lambda b: over(b) & F.exists(b["spans"], hit))


def cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """cell, held (a fifth of the rows), good and n: the counts of the candidates that are known to be good or bad."""
    text, rows = text_of(text_col), []
    for kind in KINDS:
        base = _blocks(_bare(base_spans(text, kind)))
        judged = let(base, lambda b: F.transform(_candidates(text, kind, judged=True), lambda c: F.struct(c["cell"].alias("cell"), F.when(_meets(b, c, equal=True), True).when(c["bad"], False).alias("good"))))
        rows.append(judged)
    held = F.pmod(F.xxhash64(text), F.lit(5)) == 0
    return docs.select(held.alias("held"), F.explode(F.concat(*rows)).alias("c")).where("c.good IS NOT NULL").groupBy("c.cell", "held", "c.good").agg(F.count("*").alias("n"))


def snippet_cells(spark) -> list[tuple[int, int]]:
    """(cell, good) of the labelled snippets."""
    df = literal_rows(spark, SNIPPETS, before="string", s="string", kind="string", good="int")
    m = F.struct("before", "s", F.lit("").alias("after"))
    cell = F.coalesce(*[F.when(F.col("kind") == k, let(m, lambda x: _cell(k, x))) for k in KINDS])
    return [tuple(r) for r in df.select(cell, "good").collect()]


def boost(bits: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Trees of depth two on logistic loss: (feature, (feature, low, high) if clear, the same if set)."""

    def split(x, g, h):
        """The best feature of rows x: its gain and the values of both sides."""
        best = (-1.0, 0, 0.0, 0.0)
        for f in range(x.shape[1]):
            on = x[:, f]
            sums = [(g[~on].sum(), h[~on].sum() + 1), (g[on].sum(), h[on].sum() + 1)]
            gain = sum(a * a / b for a, b in sums)
            if gain > best[0] + 1e-12:
                best = (gain, f, *(a / b for a, b in sums))
        return best

    score, trees = np.zeros(len(good)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (good - p), weight * p * (1 - p)
        tries = []
        for f in range(bits.shape[1]):
            on = bits[:, f]
            low, high = split(bits[~on], g[~on], h[~on]), split(bits[on], g[on], h[on])
            tries.append((low[0] + high[0], f, low[1:], high[1:]))
        _, f, low, high = max(tries, key=lambda t: t[0])
        trees.append((f, low, high))
        score = score + rate * _tree(bits, trees[-1])
    return trees


def _tree(bits: np.ndarray, tree: tuple) -> np.ndarray:
    f, low, high = tree
    side = lambda s: np.where(bits[:, s[0]], s[2], s[1])
    return np.where(bits[:, f], side(high), side(low))


def _weighed(counts: list[tuple], snippets: list[tuple[int, int]], each: float) -> list[tuple]:
    """(cell, good, weight) of counts (cell, good, n) and snippets; neither class of a kind has more weight from counts than the kind's snippets have."""
    kind = lambda c: c & (1 << len(KINDS)) - 1
    total, most = {}, {}
    for c, good, n in counts:
        total[kind(c), good] = total.get((kind(c), good), 0.0) + 1 + math.log(n)
    for c, _ in snippets:
        most[kind(c)] = most.get(kind(c), 0.0) + each
    return [(c, int(good), (1 + math.log(n)) * min(1.0, most.get(kind(c), 0.0) / total[kind(c), good])) for c, good, n in counts] + [(c, g, each) for c, g in snippets]


def train(counts: list[tuple], snippets: list[tuple[int, int]], threshold: float = THRESHOLD) -> list[int]:
    """The cells that are chosen. counts: (cell, held, good, n)."""
    as_bits = lambda c: (np.asarray(c, np.int64).reshape(-1, 1) >> np.arange(len(FEATURES)) & 1).astype(bool)
    fit = _weighed([(c, good, n) for c, held, good, n in counts if not held], snippets, 2.0)
    cell, good, weight = (np.array(x, float) for x in zip(*fit, strict=True))
    trees = boost(as_bits(cell), good, weight)
    score = lambda c: RATE * sum(_tree(as_bits(c), t) for t in trees)
    held = _weighed([(c, good, n) for c, h, good, n in counts if h], snippets, 1.0)
    cell, good, weight = (np.array(x, float) for x in zip(*held, strict=True))
    a, b, s = 1.0, 0.0, score(cell)
    for _ in range(50):  # a logistic curve through the held-out scores, by Newton's steps
        p = 1 / (1 + np.exp(-(a * s + b)))
        g, h = weight * (p - good), weight * p * (1 - p)
        gradient = np.array([(g * s).sum() + 1e-2 * (a - 1), g.sum()])
        hessian = np.array([[(h * s * s).sum() + 1e-2, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.linalg.solve(hessian, gradient)
    seen = np.unique([c for c, *_ in counts] + [c for c, _ in snippets]).astype(np.int64)
    chosen = seen[1 / (1 + np.exp(-(a * score(seen) + b))) >= threshold]
    return [int(c) for c in chosen]


def _found(docs: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """docs with _base and _spans."""
    chosen = train([tuple(r) for r in cells(docs, text_col).select("cell", "held", "good", "n").collect()], snippet_cells(docs.sparkSession), threshold)
    text = text_of(text_col)
    accepted = F.lit(chosen).cast("array<int>") if chosen else F.array().cast("array<int>")

    out = docs.withColumn("_base", once(F.struct(*[_bare(base_spans(text, k)).alias(k) for k in KINDS])))
    out = out.withColumn("_more", F.struct(*[F.filter(_candidates(text, k), lambda c: F.array_contains(accepted, c["cell"])).alias(k) for k in KINDS]))
    taken = F.concat(*[_blocks(F.col(f"_base.{k}")) for k in KINDS])
    kept = {}
    for k in KINDS:
        free = let(taken, lambda t: F.filter(F.col(f"_more.{k}"), lambda c: ~_meets(t, c)))
        kept[k] = _bare(free)
        taken = F.concat(taken, _blocks(kept[k]))
    none = F.forall(F.array(*[F.size(F.col(f"_more.{k}")) for k in KINDS]), lambda n: n == 0)
    spans = F.when(none, F.col("_base")).otherwise(F.struct(*[F.sort_array(F.concat(F.col(f"_base.{k}"), kept[k])).alias(k) for k in KINDS]))
    return out.withColumn("_spans", spans).drop("_more")


def find(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with base and spans: for each kind an array of start and end, base ones, and those with the added ones. Columns of these names are replaced."""
    return _found(docs, text_col, threshold).withColumns({"base": F.col("_base"), "spans": F.col("_spans")}).drop("_base", "_spans")


def listed(spans: Column) -> Column:
    """kind:start:end, by kind, then start, joined by commas."""
    return F.array_join(F.concat(*[F.transform(spans[k], lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"])) for k in KINDS]), ",")


def redact(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with each found span of text replaced by its kind in brackets."""
    found = _found(docs, text_col, threshold)
    every = F.sort_array(F.concat(*[F.transform(F.col(f"_spans.{k}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"))) for k in KINDS]))

    def cut(t: Column, spans: Column) -> Column:
        step = lambda at, s: F.when(s["start"] < at["end"], at).otherwise(F.struct(s["end"].alias("end"), F.concat(at["out"], t.substr(at["end"] + 1, s["start"] - at["end"]), F.lit("["), s["kind"], F.lit("]")).alias("out")))
        return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit("").alias("out")), step, lambda at: F.concat(at["out"], t.substr(at["end"] + 1, F.length(t))))

    return found.withColumn(text_col, let(text_of(text_col), lambda t: let(every, lambda s: cut(t, s)))).drop("_base", "_spans")
