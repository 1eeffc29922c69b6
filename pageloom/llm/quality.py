"""Quality rules: a table of thresholds compiled into one projection over counts of a text.

Only built-in expressions; no rows move. Repeated word windows are found inside the row by sorting the
windows with their places, so work grows with a text's length times its logarithm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.lambdas import let
from pageloom.llm.common import WORD

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "at", "this", "by", "from", "have", "or", "an", "not",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "nicht", "auf", "ein", "eine", "für", "im", "sich", "dem", "des", "auch", "als", "werden",
    "le", "la", "les", "de", "et", "un", "une", "est", "que", "qui", "dans", "pour", "sur", "au", "du", "avec", "pas", "par", "en", "il", "sont",
    "el", "los", "las", "y", "una", "se", "por", "con", "para", "su", "del", "no", "como", "más", "al", "lo", "es",
)


@dataclass(frozen=True)
class Rule:
    """A text fails when `measure` is below `least` or above `most`."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# The rules behind the base counts.
RULES = (
    Rule("word_length", "mean_word_chars", least=2.0, most=15.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_word_ratio", least=0.06),
    Rule("repeated_lines", "dup_line_ratio", most=0.4),
)
SYMBOLS = r"[#*$%&|<>]"
# What may stand around a word besides letters when it is looked up among the stop words.
EDGES = r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"


def windows_repeated(words: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more; each word counts once."""
    n = F.size(words)
    later = lambda k: F.slice(words, k + 1, F.greatest(n, F.lit(1)))
    zipped = F.arrays_zip(words.alias("a"), later(1).alias("b"), later(2).alias("c"), F.sequence(F.lit(0), n - 1).alias("at"))
    windows = F.sort_array(F.slice(zipped, 1, F.greatest(n - 2, F.lit(0))))

    def repeated(ordered: Column) -> Column:
        pairs = F.arrays_zip(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))).alias("x"), F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))).alias("y"))
        same = F.filter(pairs, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["x"]["at"], p["y"]["at"])))))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, s: total + s)

    return F.when(n >= 4, let(let(windows, repeated), covered)).otherwise(0)


def counts(docs: DataFrame, text: str, carry: list[Column]) -> DataFrame:
    """`carry` and the counts the measures are made of, all in the row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*carry, whole.alias("t"), F.regexp_extract_all(whole, F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD))
    bare = F.transform("words", lambda w: F.lower(F.regexp_replace(w, EDGES, "")))
    return split.select(
        *(F.col(c) for c in split.columns if c not in ("t", "words")), F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda kept: F.size(kept)).cast("long").alias("n_lines"),
        let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
        windows_repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter(bare, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"))


MEASURES = {
    "mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
}


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """array<string>: the names of the rules a row of counts fails, in the table's order."""
    def fails(rule: Rule) -> Column:
        over, under = (F.col(c) for c in MEASURES[rule.measure])
        value = F.when(under > 0, over / under).otherwise(0.0)
        bounds = [value < rule.least] if rule.least is not None else []
        bounds += [value > rule.most] if rule.most is not None else []
        broken = F.lit(False)
        for bound in bounds:
            broken = broken | bound
        return F.when(broken, F.lit(rule.name))

    return F.array_compact(F.array(*(fails(rule) for rule in rules))) if rules else F.array().cast("array<string>")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc: a struct of the row, the counts, base_failed, failed, kept) for every row of `docs`.

    Words are runs other than ASCII white space; null texts count as empty and fail the base, which asks for
    50 words and at most half of them in repeated windows. `failed` names the rules broken.
    """
    counted = counts(docs, text, [F.struct(*docs.columns).alias("doc")])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumns({"base_failed": base, "failed": failures(rules)}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
