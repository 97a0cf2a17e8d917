"""Words of texts that are written without spaces: found in a corpus, then cut by the best path.

New words.  Every string of up to ``longest`` Han characters is counted, and one character
more for its neighbours.  A word is a string of two characters or more that

* occurs ``least`` times,
* holds together: its parts would meet by chance ``cohesion`` (natural log) less often at every cut,
* is free on both sides: the entropy of its neighbours, left and right, is ``freedom`` (nats) at least.  The
  end of a run of Han characters counts as one neighbour.

Segments.  A run is cut into the words of least cost in sum; a word costs ``1000 ln(all / count)``,
rounded.  Single characters are always possible.  Of paths of equal cost the one whose last word is shorter is
taken, at every place.  Texts are cut where they are: the cuts of frequent runs are made once and held by all tasks,
other runs are cut in place with the words' costs, which are held as well.  No text is exchanged.

All steps are aggregations, joins and array expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators.lookup import DEFAULT_BOUND, Bound, held, sought, split_by_size
from hearsay.operators.spool import spool

LONGEST = 4
LEAST = 20
COHESION = 1.0
FREEDOM = 1.0
#: What all tasks may hold: of words with their costs, and of runs with their cuts.
HELD_WORDS = Bound(rows=500_000, bytes=32 << 20)
HELD_RUNS = Bound(rows=250_000, bytes=16 << 20)
_RUN = r"[\u4e00-\u9fef\p{IsHan}]+"
#: Other letters form words of their own, as in ``functions.text``.
_PIECE = _RUN + r"|[a-z[\p{L}&&[^\p{IsHan}]]]+"


def _pieces(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(_PIECE), F.lit(0)), F.array().cast("array<string>"))


def run_counts(texts: DataFrame) -> DataFrame:
    """``run, n``: the runs of Han characters of ``texts(content)`` and their occurrences."""
    runs = F.regexp_extract_all(F.lower("content"), F.lit(_RUN), F.lit(0)).alias("runs")
    return texts.select(runs).select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def gram_counts(texts: DataFrame, longest: int = LONGEST, runs: DataFrame | None = None) -> DataFrame:
    """``gram, f``: all strings of 1 to ``longest + 1`` Han characters of ``texts(content)`` and their occurrences.

    Equal runs are added up first, so a text that was posted a thousand times is cut up once.  ``runs``: their
    ``run_counts``, where they were made before.
    """
    counted = run_counts(texts) if runs is None else runs
    placed = counted.select("run", "n", F.explode(F.sequence(F.lit(1), F.char_length("run"))).alias("at"))
    room = F.least(F.lit(longest + 1), F.char_length("run") - F.col("at") + 1)
    sized = placed.select("run", "n", "at", F.explode(F.sequence(F.lit(1), room)).alias("size"))
    return sized.groupBy(F.substring("run", F.col("at"), F.col("size")).alias("gram")).agg(F.sum("n").alias("f"))


def _freedom(grams: DataFrame, known: Column, side: str) -> DataFrame:
    """``gram, <side>``: the entropy of the characters beside a string, from the strings that are one longer."""
    beside = grams.filter(F.char_length("gram") > 1).groupBy(known.alias("gram")).agg(
        F.sum("f").alias("seen"), F.sum(F.col("f") * F.ln("f")).alias("logs"))
    whole = grams.join(beside, "gram", "left")
    at_end = F.col("f") - F.coalesce("seen", F.lit(0))
    logs = F.coalesce("logs", F.lit(0.0)) + F.when(at_end > 0, at_end * F.ln(at_end)).otherwise(0.0)
    return whole.select("gram", (F.ln("f") - logs / F.col("f")).alias(side))


def _cuts(candidates: DataFrame, grams: DataFrame, total: Column) -> DataFrame:
    """``gram, cohesion``: the least log ratio of a string to its two parts, over all cuts."""
    cuts = candidates.select("gram", "f", F.explode(F.sequence(F.lit(1), F.char_length("gram") - 1)).alias("k"))
    cuts = cuts.select("gram", "f", F.substring("gram", F.lit(1), F.col("k")).alias("head"),
                       F.substring("gram", F.col("k") + 1, F.char_length("gram")).alias("tail"))
    heads = grams.select(F.col("gram").alias("head"), F.col("f").alias("head_f"))
    tails = grams.select(F.col("gram").alias("tail"), F.col("f").alias("tail_f"))
    met = cuts.join(heads, "head").join(tails, "tail")
    ratio = F.ln("f") + F.ln(total) - F.ln("head_f") - F.ln("tail_f")
    return met.groupBy("gram").agg(F.min(ratio).alias("cohesion"))


def discover(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION,
             freedom: float = FREEDOM, runs: DataFrame | None = None) -> DataFrame:
    """``word, count, cohesion, left_freedom, right_freedom`` of the words found in ``texts(content)``, 6 digits.

    Single characters are there too, without figures, so that every run can be cut.  ``runs`` as in ``gram_counts``.
    """
    grams = spool(gram_counts(texts, longest, runs), "grams")
    frequent = grams.filter(F.col("f") >= least)
    total = grams.filter(F.char_length("gram") == 1).agg(F.sum("f")).scalar()
    candidates = frequent.filter((F.char_length("gram") > 1) & (F.char_length("gram") <= longest))
    # The parts and the longer strings of a frequent one are looked up among all; neighbours can be rare.
    sides = [_freedom(grams, F.expr("substring(gram, 1, char_length(gram) - 1)"), "right_freedom"),
             _freedom(grams, F.expr("substring(gram, 2)"), "left_freedom")]
    measured = candidates.join(_cuts(candidates, frequent, total), "gram")
    for side in sides:
        measured = measured.join(side, "gram")
    words = measured.filter((F.col("cohesion") >= cohesion) & (F.col("left_freedom") >= freedom) & (F.col("right_freedom") >= freedom))
    listed = words.select(F.col("gram").alias("word"), F.col("f").alias("count"),
                          *(F.round(c, 6).alias(c) for c in ("cohesion", "left_freedom", "right_freedom")))
    none = F.lit(None).cast("double")
    single = grams.filter(F.char_length("gram") == 1).select(
        F.col("gram").alias("word"), F.col("f").alias("count"), none.alias("cohesion"), none.alias("left_freedom"),
        none.alias("right_freedom"))
    return listed.unionByName(single)


def costs(words: DataFrame) -> DataFrame:
    """``word, cost`` of ``words(word, count)``; all counts of single characters make up the whole."""
    total = words.filter(F.char_length("word") == 1).agg(F.sum("count")).scalar()
    return words.select("word", F.round(1000 * F.ln(total / F.col("count"))).cast("bigint").alias("cost"))


def _step(longest: int):
    """One way into a place: a word that ends there.  Ways come by place, then by length, one character first.

    The state holds the least costs of the last ``longest`` places, the newest first, and the last word's
    length on the best way to every place.
    """

    def step(state: Column, way: Column) -> Column:
        costs_, backs = state["costs"], state["backs"]
        fresh = way["size"] == 1
        before = F.when(fresh, costs_).otherwise(F.slice(costs_, 2, longest))
        reached = F.get(before, way["size"] - 1) + way["cost"]
        better = fresh | (reached < costs_[0])
        newest = F.when(better, reached).otherwise(costs_[0])
        lengths = F.when(fresh, F.concat(backs, F.array(F.lit(1)))).when(
            better, F.concat(F.slice(backs, 1, F.size(backs) - 1), F.array(way["size"]))).otherwise(backs)
        return F.struct(F.slice(F.concat(F.array(newest), before), 1, longest + 1).alias("costs"), lengths.alias("backs"))

    return step


def _words_of(run: Column, backs: Column) -> Column:
    """The words of a run, from the lengths of the last words on the best ways to its places."""
    start = F.struct(F.size(backs).alias("at"), F.array().cast("array<string>").alias("words"))

    def back(state: Column, place: Column) -> Column:
        size = backs[place - 1]
        word = F.substring(run, place - size + 1, size)
        return F.when(place == state["at"], F.struct(
            (place - size).alias("at"), F.concat(F.array(word), state["words"]).alias("words"))).otherwise(state)

    places = F.reverse(F.sequence(F.lit(1), F.size(backs)))
    return F.aggregate(places, start, back, lambda state: state["words"])


def _unknown(words: DataFrame) -> Column:
    """The cost of a character that is no word: that of one with half an occurrence."""
    total = words.filter(F.char_length("word") == 1).agg(F.sum("count")).scalar()
    return F.round(1000 * F.ln(2 * F.coalesce(total, F.lit(1)))).cast("bigint")


def _measured(priced: DataFrame) -> tuple[int, int]:
    return tuple(priced.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + 48), F.lit(0))).first())


def segment(runs: DataFrame, words: DataFrame, longest: int = LONGEST, bound: Bound = DEFAULT_BOUND) -> DataFrame:
    """``run, words``: every one of ``runs(run)``, cut along the best path through ``words(word, count)``.

    A character that is no word costs as much as one with half an occurrence.  The list of words is
    broadcast within ``bound``; a longer one is joined.
    """
    priced = spool(costs(words), "costs")
    small = bound.allows(*_measured(priced))
    placed = runs.select("run", F.explode(F.sequence(F.lit(1), F.char_length("run"))).alias("end"))
    sized = placed.select("run", "end", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("end")))).alias("size"))
    ways = sized.withColumn("word", F.substring("run", F.col("end") - F.col("size") + 1, F.col("size")))
    ways = ways.join(F.broadcast(priced) if small else priced, "word", "left")
    ways = ways.filter((F.col("size") == 1) | F.col("cost").isNotNull()).select(
        "run", F.struct("end", "size", F.coalesce("cost", _unknown(words)).alias("cost")).alias("way"))
    lattice = ways.groupBy("run").agg(F.sort_array(F.collect_list("way")).alias("ways"))
    start = F.struct(F.array(F.lit(0).cast("bigint")).alias("costs"), F.array().cast("array<int>").alias("backs"))
    path = F.aggregate("ways", start, _step(longest), lambda state: state["backs"])
    return lattice.select("run", path.alias("backs")).select("run", _words_of(F.col("run"), F.col("backs")).alias("words"))


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(run: Column, prices: Column, unknown: int, longest: int) -> Column:
    """The words of one run as ``segment`` finds them, with ``held`` costs.

    The state is the best way to the last place, its cost and its last word's length in one number, the least
    costs of the places before, and the lengths for those.
    """
    bits = longest.bit_length()
    older = [f"c{size}" for size in range(2, longest + 1)]
    start = F.struct(F.lit(0).cast("bigint").alias("way"), *(F.lit(None).cast("bigint").alias(c) for c in older),
                     F.array().cast("array<int>").alias("backs"))

    def lengths(state: Column) -> Column:
        return F.concat(state["backs"], F.array(state["way"].bitwiseAND(F.lit((1 << bits) - 1)).cast("int")))

    def step(state: Column, end: Column) -> Column:
        before = [F.shiftright(state["way"], bits), *(state[c] for c in older)]
        ways = []
        for size, cost in enumerate(before, 1):
            price = sought(prices, F.substring(run, end - (size - 1), F.lit(size)))
            reached = cost + (F.coalesce(price, F.lit(unknown)) if size == 1 else price)
            ways.append(F.shiftleft(reached, bits) + size)
        best = F.least(*ways) if longest > 1 else ways[0]  # of equal costs the shorter word
        return F.struct(best.alias("way"), *(b.alias(c) for b, c in zip(before, older)), lengths(state).alias("backs"))

    places = F.sequence(F.lit(1), F.char_length(run))
    backs = F.slice(F.aggregate(places, start, step, lengths), F.lit(2), F.char_length(run))  # the first is that of the start
    return _once(backs, lambda b: _words_of(run, b))


def frequent_cuts(runs: DataFrame, words: DataFrame, longest: int = LONGEST, bound: Bound = HELD_RUNS) -> DataFrame:
    """``run, words``: the most frequent of ``runs(run, n)`` that fit ``bound``, cut by ``segment``.  Pass runs that start from files."""
    head, _ = split_by_size(runs.select(F.col("run").alias("word"), F.col("n").alias("freq")), bound)
    return spool(segment(head.select(F.col("word").alias("run")), words, longest), "cuts")


def _segmented_by_join(texts: DataFrame, words: DataFrame, keys: list[str], longest: int, bound: Bound) -> DataFrame:
    """``keys, parts``: where the words are too many to be held, every run is cut once and joined to its places."""
    listed = texts.select(*keys, F.posexplode_outer(_pieces(F.col("content"))).alias("place", "piece"))
    listed = spool(listed, "pieces")
    cut = segment(listed.filter(F.col("piece").rlike(rf"^{_RUN}$")).select(F.col("piece").alias("run")).distinct(), words, longest, bound)
    # A hot run: adaptive execution splits the large side of this join.
    whole = listed.join(cut.withColumnRenamed("run", "piece"), "piece", "left")
    found = F.coalesce("words", F.when(F.col("piece").isNotNull(), F.array("piece")), F.array().cast("array<string>"))
    return whole.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", found.alias("words")))).alias("parts"))


def segmented(texts: DataFrame, words: DataFrame, key: str = "comment_id", longest: int = LONGEST,
              carry: Sequence[str] = (), cuts: DataFrame | None = None, bound: Bound = HELD_WORDS) -> DataFrame:
    """``key, carry..., words``: the words of ``texts(key, content, carry...)`` in order, Han runs cut by ``segment``.

    Every text keeps its row; rows that agree in ``key`` and ``carry`` become one, place by place.  Pass ``words`` on
    with ``tokenizer=segmented_words`` to count or score them.  The costs of ``words`` are held by all tasks
    within ``bound``; more words are joined.  ``cuts`` are the ``frequent_cuts`` of these or of like texts by
    the same words: they save time and change no result.
    """
    keys = [key, *carry]
    priced = spool(costs(words), "costs")
    n, size = _measured(priced)
    if not bound.allows(n, size):
        rows = _segmented_by_join(texts, words, keys, longest, bound)
        return rows.select(*keys, F.flatten("parts.words").alias("words"))
    unknown = texts.sparkSession.range(1).select(_unknown(words)).first()[0]
    if cuts is None:
        cuts = frequent_cuts(spool(run_counts(texts), "runs"), words, longest)
    # Selected beside the pieces and read once, the lists stay references and are never copied to rows.
    lists = F.struct(held(cuts, "run", "words", cuts.count()).alias("cuts"), held(priced, "word", "cost", n).alias("prices"))
    listed = texts.select(*keys, _pieces(F.col("content")).alias("pieces"), lists.alias("lists"))

    def words_of(piece: Column, tables: Column) -> Column:
        han_run = F.when(piece.rlike(rf"^{_RUN}$"), _cut(piece, tables["prices"], unknown, longest))
        return F.coalesce(sought(tables["cuts"], piece), han_run, F.array(piece))

    cut = _once(F.col("lists"), lambda tables: F.transform("pieces", lambda piece: words_of(piece, tables)))
    if texts.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty():
        return listed.select(*keys, F.flatten(cut).alias("words"))
    parts = F.transform(cut, lambda words, place: F.struct(place.alias("place"), words.alias("words")))
    rows = listed.select(*keys, parts.alias("parts")).groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("parts"))).alias("parts"))
    return rows.select(*keys, F.flatten("parts.words").alias("words"))


def segmented_words(words: Column) -> Column:
    """The tokenizer of texts that are cut already."""
    return words
