"""Sum of word weights per text: the join behind lexicon and Bayes scoring.

The weight table grows with the vocabulary of the labelled corpus, so its size is
measured before anything is broadcast:

* within the bound, the whole table is broadcast and no token is shuffled, only
  one partial sum per text;
* beyond it, the most frequent words that fit the bound are broadcast.  They
  settle most tokens (and all hot words the corpus knows) on the map side; only the
  open rest is shuffled, once by word to meet the remaining words, and what weighs
  something there once more by text.  Open tokens are not summed by text and word
  before: few repeat in a text, so that would be one more shuffle of nearly all of them.

Both ways give the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Per-row overhead of a broadcast hash entry besides the word itself.
_ENTRY_BYTES = 48


@dataclass(frozen=True)
class Bound:
    """Largest weight table that may be broadcast."""

    rows: int = 1_000_000
    bytes: int = 128 * 1024 * 1024

    def allows(self, rows: int, size: int) -> bool:
        return rows <= self.rows and size <= self.bytes


DEFAULT_BOUND = Bound()


def held(rows: DataFrame, key: str, value: str, n: int) -> Column:
    """``rows(key, value)``, ``n`` of them, as one value for expressions: lists by the hash of their keys, see ``sought``.

    It goes to all tasks whole, so ``rows`` has to be bounded.  ``key`` tells rows apart.
    """
    slots = max(1, 2 * n)
    filled = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(slots)).alias("id")).agg(
        F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))).alias("entries"))
    lists = rows.sparkSession.range(slots).join(filled, "id", "left").agg(F.sort_array(F.collect_list(F.struct("id", "entries"))).alias("lists"))
    return lists.select(F.col("lists.entries")).scalar()


def sought(table: Column, key: Column) -> Column:
    """The value of ``key`` in a ``held`` table, NULL without one.  ``table`` is read twice: pass a lambda variable."""
    entries = F.get(table, F.pmod(F.xxhash64(key), F.size(table)).cast("int"))
    return F.get(F.filter(entries, lambda entry: entry["key"] == key), F.lit(0))["value"]


def _octave(freq):
    """Frequencies fall into at most 64 classes by powers of two."""
    return F.floor(F.log2(F.greatest(freq, F.lit(1)).cast("double"))).cast("int")


def split_by_size(weights: DataFrame, bound: Bound = DEFAULT_BOUND):
    """``(head, tail)``: head may be broadcast, tail is None if nothing is left.

    ``weights(word, weight, freq)`` should come from files; it is measured once.
    """
    size = F.sum(F.octet_length("word") + _ENTRY_BYTES)
    classes = (
        weights.groupBy(_octave(F.col("freq")).alias("octave"))
        .agg(F.count("*").alias("rows"), size.alias("bytes"))
        .collect()  # at most 64 rows
    )
    rows = taken = 0
    lowest = None
    for cls in sorted(classes, key=lambda c: -c["octave"]):
        rows, taken = rows + cls["rows"], taken + cls["bytes"]
        if not bound.allows(rows, taken):
            break
        lowest = cls["octave"]
    else:
        return weights, None
    if lowest is None:
        return weights.limit(0), weights
    in_head = _octave(F.col("freq")) >= lowest
    return weights.filter(in_head), weights.filter(~in_head)


def score_tokens(
    tokens: DataFrame,
    weights: DataFrame,
    ids: Sequence[str],
    bound: Bound = DEFAULT_BOUND,
) -> DataFrame:
    """``ids..., score`` with ``score = sum(sign * weight)`` over the tokens of a text.

    ``tokens(ids..., word, sign)`` needs one row or more per text; rows whose word
    is NULL or unknown add nothing.  ``weights(word, weight, freq)``: one row per
    word, zero weights allowed (they keep hot neutral words out of the shuffle).
    """
    return score_columns(tokens, weights, ids, ["weight"], bound).withColumnRenamed("weight", "score")


def score_columns(
    tokens: DataFrame,
    weights: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    bound: Bound = DEFAULT_BOUND,
) -> DataFrame:
    """``ids..., columns...``: ``score_tokens`` with several weights a word, ``weights(word, columns..., freq)``.

    A word has all weights or is unknown.
    """
    ids, columns = list(ids), list(columns)
    head, tail = split_by_size(weights, bound)
    matters = reduce(Column.__or__, [F.col(c) != 0 for c in columns])
    if tail is None:
        head = head.filter(matters)
    known = tokens.join(F.broadcast(head.select("word", *columns)), "word", "left")
    gains = [F.coalesce(F.sum(F.col("sign") * F.col(c)), F.lit(0)).alias(c) for c in columns]
    settled = known.groupBy(*ids).agg(*gains)  # has every text
    if tail is None:
        return settled

    left = known.filter(F.col(columns[0]).isNull() & F.col("word").isNotNull() & (F.col("sign") != 0))
    right = tail.filter(matters).select("word", *columns)
    # A hot word unknown to the corpus: adaptive execution splits the large side of this join.
    joined = left.select(*ids, "sign", "word").join(right, "word")
    rest = joined.select(*ids, *[(F.col("sign") * F.coalesce(c, F.lit(0))).alias(c) for c in columns])
    return settled.unionByName(rest).groupBy(*ids).agg(*[F.sum(c).alias(c) for c in columns])
