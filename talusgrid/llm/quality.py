"""Quality rules: a threshold table compiled into one Spark projection.

Everything here is built-in functions: no Python runs on the executors. The
projection needs no shuffle, so a hot source or a group of copies costs what
its rows cost and no more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the of and to in that is was for with "
    "der die und das von den ein zu "
    "de la et les des le un que "
    "el los las y en una por"
).split()

#: Symbols that count against a text.
SYMBOLS = "#*$%&|<>"


#: What ``measured`` counts, and the ratios that rules speak of.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio")


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= measure <= high``; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Measures are fields that ``measured`` makes.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_word_ratio", 0.005, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used.

    Without it a filter on the verdict pulls every measure's expression into
    itself again wherever it is named.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(text: Column) -> Column:
    """A struct of the counts and ratios that rules speak of.

    ``n_repeat_words`` counts the words in 3-word windows found twice or more
    in the text: windows are sorted with their positions, neighbours with
    equal words mark positions, and the marked stretches' lengths are summed.
    The sort makes it n log n for very long texts. Null texts count as empty;
    all counts are then 0 and ratios null.
    """
    zero = F.lit(0).cast("long")

    def windows(words: Column) -> Column:
        return F.when(
            F.size(words) >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size(words) - 3),
                    lambda i: F.struct(
                        F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"),
                        i.alias("p"),
                    ),
                )
            ),
        )

    def repeated(around: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            before = (k > 0) & (x["g"] == F.get(around, F.greatest(k - 1, F.lit(0)))["g"])
            return F.coalesce(x["g"] == F.get(around, k + 1)["g"], F.lit(False)) | before

        return F.sort_array(F.transform(F.filter(around, same), lambda x: x["p"]))

    def covered(found: Column) -> Column:
        steps = F.transform(found, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(found, k + 1) - p, F.lit(3))))
        return F.coalesce(F.aggregate(steps, zero, lambda s, x: s + x.cast("long")), zero)

    def counts(t: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, zero, lambda s, w: s + F.length(w).cast("long")).alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _let(windows(words), lambda w: _let(repeated(w), covered)).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        )

    def ratios(n: Column) -> Column:
        per_word = F.nullif(n["n_words"], zero).cast("double")
        return F.struct(
            *[n[c].alias(c) for c in COUNTS],
            (n["word_chars"] / per_word).alias("mean_word_chars"),
            (n["n_symbols"] / per_word).alias("symbol_ratio"),
            (n["n_stop"] / per_word).alias("stop_word_ratio"),
            (n["n_dup_lines"] / F.nullif(n["n_lines"], zero).cast("double")).alias("dup_line_ratio"),
        )

    def split(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
        return _let(words, lambda w: _let(lines, lambda x: counts(t, w, x)))

    return _let(_let(F.coalesce(text, F.lit("")), split), ratios)


def passes(measures: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression; a null measure fails its rule."""
    tests = []
    for rule in rules:
        value = measures[rule.measure]
        if rule.low is not None:
            tests.append(value >= F.lit(float(rule.low)))
        if rule.high is not None:
            tests.append(value <= F.lit(float(rule.high)))
    return reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(True))


def base_failed(measures: Column) -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    n = measures["n_words"]
    return (n < 50) | (100 * measures["n_repeat_words"] > 50 * n)


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the measures with ``base_failed`` and ``kept``."""

    def judged(m: Column) -> Column:
        failed = base_failed(m)
        return F.struct(
            *[m[c].alias(c) for c in (*COUNTS, *RATIOS)],
            failed.alias("base_failed"),
            (~failed & passes(m, rules)).alias("kept"),
        )

    return _let(measured(text), judged)


def apply_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``q_`` measures, ``q_base_failed`` and ``q_kept``.

    Defined cases: null and empty texts have no words and fail the base test;
    repeated rows are judged each on its own; columns that ``df`` has already
    stay, but those named ``q_...`` are replaced; an empty table gives an empty
    table with the same columns.
    """
    clash = [c for c in df.columns if c.startswith("q_") and c != text_col]
    judged = df.drop(*clash).select("*", verdict(F.col(text_col), rules).alias("q_verdict"))
    names = (*COUNTS, *RATIOS, "base_failed", "kept")
    return judged.withColumns({f"q_{c}": F.col("q_verdict")[c] for c in names}).drop("q_verdict")


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, with the columns of ``df``; cases as in ``apply_rules``."""
    return df.where(verdict(F.col(text_col), rules)["kept"])
