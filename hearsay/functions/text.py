"""Words of a text as one array column, built from regular expressions only.

Letters of alphabetic scripts form words.  Chinese is written without spaces:
runs of Han characters are cut at known words (by default the negations and the
stop words of two or more characters) and the rest is read as overlapping pairs
of characters.  Any other segmentation can be plugged in wherever a ``tokenizer``
argument (text Column -> array<string> Column) is accepted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.vocabulary import NEGATIONS, STOP_WORDS

Tokenizer = Callable[[Column], Column]

_LETTERS = r"\p{L}+"
_ASCII_LETTERS = "[a-z]+"
# The first range is part of the script, and much cheaper to look for.
_HAN = r"[\u4e00-\u9fef\p{IsHan}]"
_OTHER = r"[a-z[\p{L}&&[^\p{IsHan}]]]"
# Everything from the first Han character on: a range is much cheaper to look for
# than a script, and texts it catches needlessly give the same words.
_MAYBE_HAN = r"[\u2e80-\x{10ffff}]"


def _is_han(word: str) -> bool:
    return bool(word) and all("一" <= char <= "鿿" for char in word)


KNOWN_WORDS = tuple(
    dict.fromkeys([*NEGATIONS, *(w for w in STOP_WORDS if len(w) > 1 and _is_han(w))])
)


def _han_pattern(known: Iterable[str]) -> str:
    """Known words (longest first), then other Han runs, then other letter runs."""
    ordered = sorted(set(known), key=lambda word: (-len(word), word))
    if not ordered:
        return rf"{_HAN}+|{_OTHER}+"
    alternatives = "|".join(ordered)
    rest = rf"(?:(?!{alternatives}){_HAN})+"
    return rf"{alternatives}|{rest}|{_OTHER}+"


def _pairs(run: Column) -> Column:
    """Overlapping pairs of characters; shorter runs stay whole."""
    starts = F.sequence(F.lit(1), F.char_length(run) - 1)
    return F.transform(starts, lambda i: F.substring(run, i, F.lit(2)))


def words(text: Column, known: Iterable[str] = KNOWN_WORDS) -> Column:
    """Lower-cased words of ``text`` in order; empty array for NULL or empty text."""
    known = [word for word in known if _is_han(word)]
    lowered = F.lower(text)

    def all_matches(pattern: str) -> Column:
        return F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))

    split_run = lambda piece: F.when(
        piece.rlike(rf"^{_HAN}{{3,}}$") & ~piece.isin(known), _pairs(piece)
    ).otherwise(F.array(piece))
    han = F.flatten(F.transform(all_matches(_han_pattern(known)), split_run))
    # Most of the work at scale is matching, so texts take the cheapest pattern that
    # is right for them; ASCII texts are told by their length in bytes.
    chosen = (
        F.when(F.octet_length(text) == F.char_length(text), all_matches(_ASCII_LETTERS))
        .when(text.rlike(_MAYBE_HAN), han)
        .otherwise(all_matches(_LETTERS))
    )
    return F.coalesce(chosen, F.array().cast("array<string>"))


def tokenizer(known: Iterable[str] = KNOWN_WORDS) -> Tokenizer:
    """The default tokenizer with another list of known Han words."""
    return partial(words, known=tuple(known))


def drop_stop_words(tokens: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Remove stop words and blanks; repeated words stay repeated."""
    listed = list(stop_words)
    return F.filter(tokens, lambda t: (F.trim(t) != "") & ~F.trim(t).isin(listed))


def explode_words(df: DataFrame, text: str, tokenizer: Tokenizer, *carry: str) -> DataFrame:
    """``carry..., word``: one row per word, and one with NULL for a text without words.

    The words are a column of their own first: a generator that contains the whole
    tokenizer would fall out of code generation, with all rows it emits.  The plain
    ``explode`` would add a filter on the number of words below that column, and so
    tokenise every text twice.
    """
    listed = df.select(*carry, tokenizer(F.col(text)).alias("words"))
    return listed.select(*carry, F.explode_outer("words").alias("word"))


def with_previous(tokens: Column) -> Column:
    """``array<struct<word, previous>>`` with one closing entry whose word is NULL.

    The closing entry gives every text, also an empty one, at least one row once
    the array is exploded.
    """
    shifted = F.concat(F.array(F.lit("")), tokens)
    return F.arrays_zip(tokens.alias("word"), shifted.alias("previous"))
