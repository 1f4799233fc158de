"""Operator 2: a quality classifier by co-training.

Two views of a document are judged by classifiers of their own: its text (hashed words and shares of kinds of bytes)
and its page's metadata (language, source, length). In each round both score all unlabelled documents, and each gives
those of which it is surest to the other as pseudo-labels. Both are then calibrated on held-out labels, and their
calibrated scores are combined.

Bounds: fitting uses at most `labelled` labelled documents, chosen by the hash of the id (labels beyond count as none),
and `exchanged` pseudo-labels a view and round; both are parameters. Scoring, of pseudo-labels too, covers all rows and
whole texts.

Defined results: a null text is empty, null metadata is a value of its own. Several labels of one id are averaged, null
labels ignored; of rows that share a labelled id the one with the least features is fitted on; rows of equal id and text
are one pseudo-label. Without labels of both classes every score is 0.5. Labels of unknown ids are ignored and use up no
bound. Every input row has one output row. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import checkpoint, map_arrow, text_of
from quernel.llm.substring_dedup import SEPARATOR, hashed, word_hashes, word_spans

LABELLED, EXCHANGED, ROUNDS = 4000, 400, 5
#: A view is sure of a document whose score, a logit, is beyond this.
SURE = 2
#: Tasks over which the candidates of one view and class are first ranked.
SALTS = 64
HASHED = 512
#: Bytes of texts whose words are hashed in one step.
GROUP = 1 << 19
#: Kinds of bytes: lower case, upper case, digits, separators, line ends, other ASCII by its six bits, the rest.
BYTE_KIND = np.full(256, 5, np.int64)
BYTE_KIND[ord("a") : ord("z") + 1], BYTE_KIND[ord("A") : ord("Z") + 1], BYTE_KIND[ord("0") : ord("9") + 1] = 0, 1, 2
BYTE_KIND[SEPARATOR] = 3
BYTE_KIND[10] = 4
BYTE_KIND[128:] = 6
for _i, _c in enumerate("!#$%&*|.,<>"):
    BYTE_KIND[ord(_c)] = 7 + _i
N_KINDS = int(BYTE_KIND.max()) + 1
TEXT_SIZE = HASHED + N_KINDS + 5
META_SIZE = 128


def text_features(text: bytes) -> np.ndarray:
    return texts_features([text])[0]


def texts_features(texts: list[bytes]) -> np.ndarray:
    """A row of features for each text; texts are read in groups of up to GROUP bytes, a longer one by itself."""
    out = np.zeros((len(texts), TEXT_SIZE), np.float32)
    out[:, -1] = 1
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > GROUP:
            _group_features(texts[start:i], out[start:i])
            start, size = i, 0
        size += len(text) + 1
    if texts:
        _group_features(texts[start:], out[start:])
    return out


def _group_features(texts: list[bytes], out: np.ndarray) -> None:
    """Fill out, which holds only the constant."""
    sizes = np.array([len(t) for t in texts])
    for i, text in enumerate(texts):
        kinds = np.zeros(N_KINDS)
        for start in range(0, len(text), 1 << 22):
            kinds += np.bincount(BYTE_KIND[np.frombuffer(text, np.uint8, min(1 << 22, len(text) - start), start)], minlength=N_KINDS)
        out[i, HASHED : HASHED + N_KINDS] = np.sqrt(kinds / max(1, len(text)))
    if len(texts) == 1:
        words = word_hashes(texts[0], 1)[0]
        n = np.array([len(words)])
    else:
        joined = b" ".join(texts)
        begin, stop = word_spans(joined)
        edge = np.searchsorted(begin, np.r_[0, np.cumsum(sizes + 1)])
        words = hashed(joined, begin, stop, 1)[0] if len(begin) else np.zeros(0, np.uint64)
        n = np.diff(edge)
    if not len(words):
        return
    of = np.repeat(np.arange(len(texts)), n)
    counts = np.bincount(of * HASHED + (words % np.uint64(HASHED)).astype(np.int64), minlength=len(texts) * HASHED)
    some = np.maximum(n, 1)
    out[:, :HASHED] = np.sqrt(counts.reshape(-1, HASHED)) / np.sqrt(some)[:, None]
    equal = lambda: np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=len(texts))
    again = equal()
    end = np.cumsum(n)
    for a, b in zip((end - n).tolist(), end.tolist(), strict=True):
        words[a:b].sort()
    out[:, -5:-1] = np.stack([(n - equal()) / some, np.log1p(n) / 10, again / np.maximum(n - 1, 1), np.where(n > 0, np.minimum(1, sizes / some / 20), 0)], axis=1)


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(META_SIZE, np.float32)
    out[-1] = 1
    out[xxh64_intdigest(repr(lang), 1) % 16] = 1
    out[16 + xxh64_intdigest(repr(source), 2) % 64] = 1
    size = np.log2(1 + max(0.0, n_chars or 0))
    out[80 + min(30, int(2 * size))] = 1
    out[-2] = size / 20
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton's steps; classes weigh alike."""
    w = np.zeros(x.shape[1])
    x = x.astype(float)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def cotrain(text: np.ndarray, meta: np.ndarray, label: np.ndarray, surest=None, rounds: int = ROUNDS) -> dict[str, np.ndarray] | None:
    """The weights of both views and of their calibration and combination. label: 0 or 1.

    surest(weights, share) gives (view, value, text features, meta features) of documents that weren't given before and of
    which a view is surest, where share is that of good labels.
    """
    held = np.arange(len(label))[::4]
    own = np.setdiff1d(np.arange(len(label)), held)
    if any(len(np.unique(label[part])) < 2 for part in (held, own)):
        return None
    views = {"text": text, "meta": meta}
    given = {v: (list(x[own]), list(label[own])) for v, x in views.items()}
    share = label[own].mean()
    weights = {}
    for k in range(rounds + 1):
        for v, (x, y) in given.items():
            weights[v] = fit(np.array(x), np.array(y))
        found = surest(weights, share) if surest and k < rounds else []
        if not found:
            break
        for v, value, *features in found:
            other = "meta" if v == "text" else "text"
            given[other][0].append(features[list(views).index(other)])
            given[other][1].append(value)
    scores = np.stack([views[v][held] @ weights[v] for v in views], axis=1)
    for i, v in enumerate(views):  # one held-out part calibrates, with the classes as frequent as they are
        weights[f"{v}_curve"] = _curve(scores[::2, i : i + 1], label[held[::2]])
    calibrated = np.stack([np.clip(np.c_[scores[:, i], np.ones(len(held))] @ weights[f"{v}_curve"], -8, 8) for i, v in enumerate(views)], axis=1)
    weights["both"] = _curve(calibrated[1::2], label[held[1::2]])
    return weights


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve with a slope for each column, and an intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.r_[np.full(x.shape[1] - 1, 0.5), 0.0]
    start = w.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * (w - start))
    return w


def _scores(weights: dict | None, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if weights is None:
        return (np.full(len(text), 0.5),) * 3
    raw = [np.clip(np.c_[x @ weights[v], np.ones(len(x))] @ weights[f"{v}_curve"], -8, 8) for v, x in (("text", text), ("meta", meta))]
    both = np.stack([*raw, np.ones(len(text))], axis=1) @ weights["both"]
    return tuple(1 / (1 + np.exp(-x)) for x in (*raw, both))


def _features(batch) -> tuple[np.ndarray, np.ndarray]:
    text = texts_features(batch.column("text").to_pylist())
    meta = np.stack([meta_features(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)])
    return text, meta


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    of = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"), of("lang", "string"), of("source", "string"), of("n_chars", "double"))


def _sample(slim: DataFrame, labels: DataFrame, label_col: str, id_col: str, labelled: int) -> DataFrame:
    """id and label of at most `labelled` labelled documents."""
    mean = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    return checkpoint(mean.join(slim.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(labelled))


def _featured(rows: DataFrame) -> DataFrame:
    """key and x, the least features, of each key of rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                features = [np.concatenate(x).astype(np.float32).tobytes() for x in zip(*_features(batch), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(features, pa.binary())], ["key", "x"])

    schema = T.StructType([rows.schema["key"], T.StructField("x", T.BinaryType())])
    return map_arrow(rows.select("key", "text", "lang", "source", "n_chars"), run, schema).groupBy("key").agg(F.min("x").alias("x"))


def _split(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(x, np.float32)
    return both[:TEXT_SIZE], both[TEXT_SIZE:]


def _surest(others: DataFrame, exchanged: int):
    """The function that cotrain() asks, over all rows of others, which have a key."""
    taken: set[int] = set()

    def ask(weights: dict, share: float) -> list[tuple]:
        views, known = [weights["text"], weights["meta"]], np.array(sorted(taken), np.int64)
        most = [max(1, round(exchanged * (1 - share))), max(1, round(exchanged * share))]  # of bad and of good ones

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    key, first = np.unique(part.column("key").to_numpy(zero_copy_only=False), return_index=True)
                    part = part.take(pa.array(first[~np.isin(key, known)]))
                    if not part.num_rows:
                        continue
                    key = part.column("key").to_numpy(zero_copy_only=False)
                    score = np.stack([x @ w for x, w in zip(_features(part), views, strict=True)])
                    view, at = np.nonzero(np.abs(score) > SURE)
                    strength = score[view, at]
                    yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array((strength > 0).astype(np.int32)), pa.array(np.abs(strength)), pa.array(key[at])], ["view", "value", "strength", "key"])

        candidates = map_arrow(others.select("key", "text", "lang", "source", "n_chars"), run, "view int, value int, strength double, key long")
        bound = F.when(F.col("value") == 1, most[1]).otherwise(most[0])
        # a key is in one salt alone; the surest of all are among the surest of each salt
        candidates = candidates.groupBy("view", "value", "key", F.pmod("key", F.lit(SALTS)).alias("salt")).agg(F.max("strength").alias("strength"))
        for group in (["view", "value", "salt"], ["view", "value"]):
            rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("strength"), "key"))
            candidates = candidates.withColumn("rank", rank).where(F.col("rank") <= max(most)).where(F.col("rank") <= bound)
        chosen = checkpoint(candidates.select("view", "value", "key"))  # at most 4 * exchanged rows
        keys = F.broadcast(chosen.select("key").distinct())
        rows = {r["key"]: _split(r["x"]) for r in _featured(others.join(keys, "key", "left_semi")).collect()}
        taken.update(rows)
        return [(("text", "meta")[r["view"]], float(r["value"]), *rows[r["key"]]) for r in chosen.orderBy("view", "value", "key").collect()]

    return ask


def score(docs: DataFrame, weights: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_score, meta_score and score, a calibrated probability of being good, for each row of docs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = _scores(weights, *_features(part))
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, found)], ["id", "text_score", "meta_score", "score"])

    slim = _slim(docs, id_col, text_col)
    fields = [slim.schema["id"], *[T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")]]
    return map_arrow(slim, run, T.StructType(fields)).withColumnRenamed("id", id_col)


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> DataFrame:
    """Fit on a bounded sample of labels and on pseudo-labels of all other rows, and score all rows of docs."""
    slim = _slim(docs, id_col, text_col)
    chosen = F.broadcast(_sample(slim, labels, label_col, id_col, labelled))  # at most labelled rows
    known = _featured(slim.join(chosen, "id").withColumn("key", F.struct("id", "label"))).select("key.id", "key.label", "x").orderBy(F.xxhash64("id"), "id").collect()
    weights = None
    if known:
        text, meta = (np.stack(x) for x in zip(*[_split(r["x"]) for r in known], strict=True))
        others = slim.join(chosen, "id", "left_anti").withColumn("key", F.xxhash64("id", "text"))
        weights = cotrain(text, meta, np.array([r["label"] for r in known]), _surest(others, exchanged), rounds)
    return score(docs, weights, id_col, text_col)
