"""Operator 10: quality rules from a threshold table, compiled into one projection of built-in functions.

Defined results: a null or empty text has no words and fails the rule on length. A text in a language without a
stop-word list isn't judged by stop words. Rows are judged one by one, so ties, repeated rows and extra columns
change nothing; columns of the input that are named like a result are replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import SEPARATORS, let, once, text_of, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent function words, by language.
STOP_WORDS = {
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "in", "an", "es"],
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "was", "on", "as", "at", "by", "he", "are"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "lo"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
}


@dataclass(frozen=True)
class Rule:
    """A text fails where measure is outside [least, most]; a null measure never fails."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    base: bool = False


#: The threshold table. The first two are the base; the others are ratios that ordinary prose is far from.
RULES = [
    Rule("too_short", "n_words", least=20, base=True),
    Rule("repetition", "repeat_percent", most=30, base=True),
    Rule("word_length", "mean_word_length", least=1.5, most=20),
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("shouting", "upper_ratio", most=0.5),
    Rule("stop_words", "stop_word_ratio", least=0.01),
    Rule("duplicate_lines", "dup_line_ratio", most=0.7),
]


def _covered(hashes: Column, width: int) -> Column:
    """How many positions the windows cover whose hash is found twice or more."""

    def spread(places: Column) -> Column:
        step = lambda p, i: F.when(i + 1 < F.size(places), F.least(F.lit(width), F.get(places, i + 1) - p)).otherwise(width)
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        near = lambda e, i: F.coalesce((i > 0) & (F.get(pairs, F.greatest(i - 1, F.lit(0)))["h"] == e["h"]), F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, near), lambda e: e["p"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    found = let(let(pairs, repeated), spread)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words that stand in a window of `width` words found twice or more among these words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(let(hashed, windows), lambda h: _covered(h, width))).cast("long")


def _measures(text: Column, lang: Column) -> Column:
    """All counts of a text, in one struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    stops = F.create_map(*[x for k, v in STOP_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def of(words: Column) -> Column:
        listed = F.element_at(stops, F.coalesce(lang, F.lit("")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeat_words(words).alias("n_repeat_words"),
            F.when(listed.isNotNull(), let(listed, lambda s: F.size(F.filter(words, lambda w: F.array_contains(s, F.lower(F.rtrim(w, F.lit("!.,;:?*$%&#"))))))))
            .cast("long")
            .alias("n_stop_words"),
        )

    return let(words_of(text), of)


def quality_rules(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with the counts, the ratios' verdict as base_failed, failed (names of failed rules) and kept."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    m = lambda name: F.col(f"_measures.{name}")
    words = F.greatest(m("n_words"), F.lit(1))
    measures = {
        "n_words": m("n_words"),
        "repeat_percent": F.lit(100) * m("n_repeat_words") / words,
        "mean_word_length": m("word_chars") / words,
        "symbols_per_word": m("n_symbols") / words,
        "upper_ratio": m("n_upper") / F.greatest(m("word_chars"), F.lit(1)),
        "stop_word_ratio": m("n_stop_words") / words,
        "dup_line_ratio": m("lines.dup") / F.greatest(m("lines.n"), F.lit(1)),
    }

    def fails(rule: Rule) -> Column:
        x = measures[rule.measure]
        if rule.measure == "repeat_percent":  # in integers, so that no rounding decides
            return F.lit(100) * m("n_repeat_words") > F.lit(int(rule.most)) * m("n_words")
        low = x < rule.least if rule.least is not None else F.lit(False)
        return F.coalesce(low | (x > rule.most if rule.most is not None else F.lit(False)), F.lit(False))

    names = lambda base: F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules if r.base or not base]), lambda x: x.isNotNull())
    base = reduce(lambda a, b: a | b, [fails(r) for r in rules if r.base], F.lit(False))
    measured = docs.withColumn("_measures", once(_measures(text_of(text_col), lang)))
    out = {c: m(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")} | {"n_dup_lines": m("lines.dup"), "base_failed": base, "failed": names(False)}
    return measured.withColumns(out).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_measures")


def keep(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that a rule rejects, with the columns of docs alone."""
    marked = docs.select(F.struct(*docs.columns).alias("_row"), *[F.col(c) for c in {text_col, lang_col} & {*docs.columns}])
    return quality_rules(marked, rules, text_col, lang_col).where("kept").select("_row.*")


def oracle_sql() -> str:
    """What op10_quality_rules returns, as DuckDB SQL; the thresholds are those of RULES, ids are distinct there."""
    of = {r.name: r for r in RULES}
    stops = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in STOP_WORDS.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
hashed AS (SELECT doc_id, list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' '))) AS h FROM d WHERE len(w) >= 8),
placed AS (SELECT doc_id, unnest(h) AS x, unnest(range(1, len(h) + 1)) AS i FROM hashed),
twice AS (SELECT doc_id, x FROM placed GROUP BY doc_id, x HAVING count(*) > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS k FROM placed JOIN twice USING (doc_id, x)) GROUP BY doc_id),
m AS (SELECT doc_id, lang, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
             list_filter(w, lambda x: list_contains(CASE lang {stops} END, lower(rtrim(x, '!.,;:?*$%&#')))) AS s FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < {of["too_short"].least} OR 100 * n_repeat_words > {of["repetition"].most} * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n BETWEEN {of["word_length"].least} AND {of["word_length"].most} AND n_symbols / n <= {of["symbols"].most}
       AND n_upper / greatest(word_chars, 1)::DOUBLE <= {of["shouting"].most} AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= {of["duplicate_lines"].most}
       AND (lang IS NULL OR lang NOT IN ({", ".join(repr(k) for k in STOP_WORDS)}) OR len(s) / n >= {of["stop_words"].least}) AS kept
FROM b"""
