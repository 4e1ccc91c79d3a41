"""Quality rules: a threshold table compiled into one projection over whole texts.

All statistics and verdicts are built-in expressions.  Windows of words are compared by a 64-bit hash inside one text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.llm.common import SPACE

WINDOW = 8

#: Frequent short words of English, French, Spanish and German.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "au", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ou", "par", "pour", "que", "qui", "un", "une",
    "como", "con", "del", "el", "es", "las", "lo", "los", "no", "por", "se", "su", "y",
    "das", "dem", "den", "der", "die", "ein", "ist", "mit", "nicht", "sich", "und", "von", "zu",
)


@dataclass(frozen=True)
class Rule:
    """A text passes when the ratio lies in [low, high]; None leaves that end open."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: Ratios are expressions over the statistics below.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("mean_word_length", "word_chars / n_words", low=2.0, high=20.0),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.1),
    Rule("stop_word_share", "n_stop_words / n_words", low=0.02),
    Rule("duplicate_line_share", "n_dup_lines / n_lines", high=0.6),
    Rule("ellipsis_line_share", "n_ellipsis_lines / n_lines", high=0.3),
    Rule("bullet_line_share", "n_bullet_lines / n_lines", high=0.9),
)


def _repeated_words(windows: str, words: str) -> Column:
    """Words covered by windows whose hash occurs twice or more; only texts with such windows pay for the sort."""
    starts = (
        f"transform(array(sort_array(transform({windows}, (h, i) -> struct(h AS h, i AS i)))), s -> sort_array(filter("
        "transform(s, (x, k) -> CASE WHEN get(s, k - 1).h = x.h OR get(s, k + 1).h = x.h THEN x.i END), p -> p IS NOT NULL)))[0]"
    )
    covered = (
        f"transform(array({starts}), p -> aggregate(transform(p, (x, k) -> CAST(least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW})) AS BIGINT)), "
        "0L, (a, x) -> a + x))[0]"
    )
    return F.expr(f"CASE WHEN size(array_distinct({windows})) < size({windows}) THEN {covered} ELSE 0L END")


def text_statistics(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the counts the rules need.

    A null text counts as empty.  Other columns of ``docs`` are not read, so their names cannot clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = ", ".join(f"'{word}'" for word in STOP_WORDS)
    ids = [F.col(c) for c in keep]
    cut = docs.select(
        *ids,
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, SPACE), lambda word: word != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    hashed = cut.withColumn(
        "_windows",
        F.expr(
            f"CASE WHEN size(_words) < {WINDOW} THEN CAST(array() AS ARRAY<BIGINT>) "
            f"ELSE transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) END"
        ),
    )
    return hashed.select(
        *ids,
        F.size("_words").cast("long").alias("n_words"),
        F.expr("aggregate(_words, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words("_windows", "_words").alias("n_repeat_words"),
        F.expr(f"CAST(size(filter(_words, w -> lower(w) IN ({stop}))) AS BIGINT)").alias("n_stop_words"),
        F.expr("CAST(size(filter(_lines, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS BIGINT)").alias("n_ellipsis_lines"),
        F.expr("CAST(size(filter(_lines, x -> substr(ltrim(x), 1, 1) IN ('-', '*', '•'))) AS BIGINT)").alias("n_bullet_lines"),
    )


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """True when every rule holds; a ratio without a value (nothing to divide by) does not fail its rule."""
    verdict = F.lit(True)
    for rule in rules:
        ratio = F.expr(rule.ratio.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"))
        if rule.low is not None:
            verdict = verdict & F.coalesce(ratio >= F.lit(rule.low), F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(ratio <= F.lit(rule.high), F.lit(True))
    return verdict


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Statistics of every document with ``base_failed`` and ``kept``.

    One output row per input row: repeated rows repeat, a null id stays null, a null, empty or blank text has no words
    and fails the base rule, an empty table gives an empty table.
    """
    stats = text_statistics(docs, keep)
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
