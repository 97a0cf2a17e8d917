"""Quality rules: a table of thresholds compiled into one Spark projection.

Every ratio is a pair of whole-number measures, so the verdict is exact and SQL can
repeat it.  Only built-in functions are used.  A null text counts as empty: it has no
words and fails.  Rows are neither dropped nor merged, repeated rows give repeated
results, and other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import as_text

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "with", "on", "as", "was", "by", "be",
    "der", "die", "das", "und", "den", "ein", "eine", "mit", "von", "nicht", "zu", "ist", "im", "sich",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "dans", "en", "est", "pour",
    "el", "los", "las", "y", "se", "no", "por", "con", "su", "para", "del", "al", "una",
)


@dataclass(frozen=True)
class Rule:
    """``least <= 100 * measure / base <= most``; a missing limit does not bind."""

    measure: str
    base: str
    least: int | None = None
    most: int | None = None

    def passes(self) -> Column:
        value, limits = 100 * F.col(self.measure), []
        if self.least is not None:
            limits.append(value >= self.least * F.col(self.base))
        if self.most is not None:
            limits.append(value <= self.most * F.col(self.base))
        return reduce(and_, limits)


BASE_RULES = (Rule("n_words", "one", least=5000), Rule("n_repeat_words", "n_words", most=50))
RULES = (
    Rule("n_words", "one", most=10_000_000),
    Rule("word_chars", "n_words", least=200, most=1500),
    Rule("n_symbols", "n_words", most=20),
    Rule("n_stop_words", "n_words", least=5),
    Rule("n_dup_lines", "n_lines", most=40),
)


def measured(docs: DataFrame, key: str = "doc_id", stop_words=STOP_WORDS) -> DataFrame:
    """``key`` and the whole-number measures of every text."""
    text = as_text()
    split = docs.select(
        F.col(key), text.alias("text"),
        F.array_remove(F.split(text, SPACES), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"),
                           i.alias("i")),
    )).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    hashed = split.select(
        key, n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size(F.filter("words", lambda w: w.isin(*stop_words))).cast("bigint").alias("n_stop_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(windows).alias("windows"),
    )

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    twice = F.filter("windows", lambda x, j: same(F.get("windows", j + 1), x) | same(F.get("windows", j - 1), x))
    covered = hashed.withColumn("found", F.sort_array(F.transform(twice, lambda x: x["i"])))
    step = F.transform("found", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("found", j + 1) - x, F.lit(3))))
    return covered.withColumn(
        "n_repeat_words", F.aggregate(step, F.lit(0), lambda a, b: a + b).cast("bigint")
    ).drop("windows", "found")


def judge(docs: DataFrame, key: str = "doc_id", rules=RULES, base_rules=BASE_RULES) -> DataFrame:
    """Measures with ``base_failed`` and ``kept`` for every row of ``docs(key, text)``."""
    rows = measured(docs, key).withColumn("one", F.lit(1))
    passed = rows.withColumn("base_failed", ~reduce(and_, [r.passes() for r in base_rules]))
    return passed.withColumn("kept", ~F.col("base_failed") & reduce(and_, [r.passes() for r in rules])).drop("one")
