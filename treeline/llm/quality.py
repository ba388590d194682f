"""Quality rules: a threshold table compiled into one Spark projection (no user functions).

Every rule is a row ``Rule(name, numerator, denominator, low, high)`` over counts that the
projection derives from the whole text.  ``score_quality`` adds the counts, one boolean per rule
and the verdict.  Null text counts as empty: no words, so the base rule rejects it.  Empty tables
give empty results; extra columns of the input are not read, so their names cannot clash.
Repeated rows are each judged on their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
SYMBOLS = r"#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at an from or "
    "le la les de des un une et en que qui est pour pas dans sur par avec il au ce "
    "der die das und ist nicht von mit den dem ein eine zu auf sich im für es auch "
    "el los las del y por con una se su lo como no más para al"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= numerator / denominator <= high; a zero denominator counts as 1."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.col(self.numerator)
        if self.denominator:
            value = value / F.greatest(F.col(self.denominator), F.lit(1))
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (value <= F.lit(self.high))
        return ok


RULES = (
    Rule("length", "n_words", None, 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.10),
    Rule("shouting", "n_shout", "n_words", None, 0.30),
    Rule("stop_words", "n_stop", "n_words", 0.06, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.30),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.50),
)


def _window_keys(words: Column, n: Column) -> Column:
    """Sorted longs (hash of a 3-word window << 31 | position), a primitive array."""
    return F.sort_array(
        F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), n - F.lit(3)),
                lambda i: F.shiftleft(F.hash(words[i], words[i + 1], words[i + 2]).cast("bigint"), 31) + i.cast("bigint"),
            ),
        ).otherwise(F.array().cast("array<bigint>"))
    )


def _same_window(a: Column, b: Column) -> Column:
    return F.shiftright(a, 31) == F.shiftright(b, 31)


def text_counts(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The counts of every whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop, n_shout (all long).

    n_repeat_words: windows are first matched by hash, then the matches' words are compared, so
    a hash collision never counts; cost is that of sorting longs, n log n in the words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step1 = df.select(
        *keep,
        t.alias("_t"),
        F.filter(F.split(t, WS + "+"), lambda x: x != "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_WS)).alias("_l"),
    )
    step2 = step1.select(
        *keep,
        "_w",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", f"[{SYMBOLS}]", ""))).cast("bigint").alias("n_symbols"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("bigint").alias("n_stop"),
        (F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))).cast("bigint").alias("n_shout"),
        _window_keys(F.col("_w"), F.size("_w")).alias("_k"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop", "n_shout"]
    # Positions whose hash occurs more than once (neighbours in the sorted keys).
    step3 = step2.select(
        *keep,
        *counts,
        "_w",
        F.filter(
            "_k",
            lambda x, i: (F.when(i > 0, _same_window(x, F.get("_k", i - 1))).otherwise(F.lit(False)))
            | F.coalesce(_same_window(x, F.get("_k", i + 1)), F.lit(False)),
        ).alias("_c"),
    )
    # Of these, exact windows: their words joined, then again neighbours in sorted order.
    step4 = step3.select(
        *keep,
        *counts,
        F.sort_array(
            F.transform(
                "_c",
                lambda x: F.struct(
                    F.concat_ws(" ", F.slice("_w", x.bitwiseAND(F.lit(2**31 - 1)).cast("int") + 1, 3)).alias("g"),
                    x.bitwiseAND(F.lit(2**31 - 1)).alias("p"),
                ),
            )
        ).alias("_g"),
    )
    step5 = step4.select(
        *keep,
        *counts,
        F.sort_array(
            F.transform(
                F.filter(
                    "_g",
                    lambda x, i: F.when(i > 0, x["g"] == F.get("_g", i - 1)["g"]).otherwise(F.lit(False))
                    | F.coalesce(x["g"] == F.get("_g", i + 1)["g"], F.lit(False)),
                ),
                lambda x: x["p"],
            )
        ).alias("_p"),
    )
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("bigint"), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return step5.select(*keep, *counts, covered.alias("n_repeat_words"))


def score_quality(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts, base_failed, failed_rules (array of rule names) and kept for each row."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    return (
        text_counts(df, text, keep)
        .withColumn("base_failed", base_failed)
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
