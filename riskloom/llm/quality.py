"""Quality rules: a table of thresholds compiled into one projection, with no user function.

``MEASURES`` are the base counts of a text, ``RATIOS`` name expressions over them, and ``THRESHOLDS`` is the rule table
(ratio, lowest, highest allowed). ``judge`` turns the table into flags; a caller may pass a table of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let, words_of

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it that was for on are with as be by this at from or an not have has "
    "der die das und ist in von zu mit den des ein eine nicht es auf dem im für sie "
    "le la les de des du et est un une que qui dans pour pas sur au avec par "
    "el los las y en que por con una para se no es del al lo su"
).split()

RATIOS: dict[str, str] = {
    "n_words": "n_words",
    "mean_word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "stop_words_per_word": "n_stop_words / n_words",
    "upper_letters_per_char": "n_upper / word_chars",
    "marks_per_word": "n_marks / n_words",
    "repeated_lines_per_line": "n_dup_lines / n_lines",
    "repeated_words_per_word": "n_repeat_words / n_words",
}
# (ratio, lowest, highest); None leaves a side open. A ratio without a denominator passes.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 10, None),
    ("repeated_words_per_word", None, 0.2),
    ("mean_word_length", 2, 12),
    ("symbols_per_word", None, 0.1),
    ("upper_letters_per_char", None, 0.5),
    ("marks_per_word", None, 0.5),
    ("repeated_lines_per_line", None, 0.5),
    ("stop_words_per_word", 0.02, None),
)


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the array, the first occurrence included.

    Windows are compared by 64-bit hash. Only a text with repeats sorts its windows; the cost is n log n at most.
    """

    def windows(hashes: Column) -> Column:
        at = F.when(F.size(hashes) >= window, F.sequence(F.lit(0), F.size(hashes) - window)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    def covered(sorted_windows: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            other = [F.coalesce(F.get(sorted_windows, i + d)["w"] == x["w"], F.lit(False)) for d in (-1, 1)]
            return other[0] | other[1]

        places = F.sort_array(F.transform(F.filter(sorted_windows, twin), lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
            F.lit(0), lambda a, x: a + x))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), covered))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count)).cast("bigint")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``RATIOS``. A null text counts as empty; input columns of the same names are replaced."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    made = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_upper", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(*keep, t.alias("__t"), words_of(t).alias("__w"), lines.alias("__l"))

    def gone(pattern: str) -> Column:
        return (F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))).cast("bigint")

    stop = F.filter("__w", lambda x: F.lower(F.rtrim(x, F.lit(".,!?;:"))).isin(STOP_WORDS))
    return rows.select(
        *keep, F.size("__w").cast("bigint").alias("n_words"), F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        gone(SYMBOLS + "+").alias("n_symbols"), F.size(stop).cast("bigint").alias("n_stop_words"), gone(r"\p{Lu}+").alias("n_upper"),
        gone(r"[!?]+").alias("n_marks"), F.size("__l").cast("bigint").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        repeated_window_words(F.col("__w")).alias("n_repeat_words"))


def judge(measured: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """``measured`` with one flag array ``failed`` (names of the failed rules) and ``kept``."""
    checks = []
    for name, low, high in thresholds:
        over, _, under = RATIOS[name].partition(" / ")
        # Products instead of quotients, so that a share at its limit passes exactly.
        top, bottom = F.col(over), F.col(under) if under else F.lit(1)
        bad = F.lit(False)
        if low is not None:
            bad = bad | (top * 1000 < bottom * round(low * 1000))
        if high is not None:
            bad = bad | (top * 1000 > bottom * round(high * 1000))
        checks.append(F.when(bad, F.lit(name)))
    failed = F.array_compact(F.array(*checks))
    return measured.withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)
