import random

import pytest

from hearsay.operators import lookup
from hearsay.operators.sentiment import build_lexicon, class_word_counts, label_sentiment

LEXICON = [("good", 1), ("great", 1), ("bad", -1), ("awful", -1)]
NEGATIONS = ["not", "never"]


def by_hand(text, lexicon=dict(LEXICON)):
    """The scoring rule, word by word."""
    score, flip = 0, False
    for word in (text or "").lower().split():
        if word in NEGATIONS:
            flip = True
            continue
        score += lexicon.get(word, 0) * (-1 if flip else 1)
        flip = False
    return "positive" if score > 0 else "negative" if score < 0 else "neutral"


def labels(spark, texts, bound=lookup.DEFAULT_BOUND, lexicon=LEXICON):
    comments = spark.createDataFrame(list(enumerate(texts)), "comment_id BIGINT, content STRING")
    table = spark.createDataFrame(lexicon, "word STRING, polarity INT")
    rows = label_sentiment(comments, table, NEGATIONS, bound=bound).collect()
    found = {row["comment_id"]: row["sentiment"] for row in rows}
    assert len(found) == len(rows) == len(texts)
    return [found[i] for i in range(len(texts))]


CASES = {
    None: "neutral",
    "": "neutral",
    "nothing known here": "neutral",
    "good": "positive",
    "GOOD": "positive",
    "bad": "negative",
    "not good": "negative",
    "not bad": "positive",
    "not not good": "negative",
    "not": "neutral",
    "not unknown good": "positive",
    "good bad": "neutral",
    "good great bad": "positive",
    "bad not": "negative",
    "never, good": "negative",
}


def test_every_rule(spark):
    assert labels(spark, list(CASES)) == list(CASES.values())


@pytest.mark.parametrize("bound", [lookup.DEFAULT_BOUND, lookup.Bound(rows=2), lookup.Bound(rows=0)])
def test_any_bound_gives_the_labels_of_the_rule(spark, bound):
    rng = random.Random(7)
    pool = [w for w, _ in LEXICON] + NEGATIONS + ["x", "y", "z"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(0, 12))) for _ in range(300)]
    texts += ["good " * 2000 + "bad", None, ""]  # one hot word
    assert labels(spark, texts, bound) == [by_hand(t) for t in texts]


def test_a_chinese_text_with_negation(spark):
    comments = spark.createDataFrame(
        [(1, "手机耐用"), (2, "手机不耐用"), (3, "手机")], "comment_id BIGINT, content STRING"
    )
    lexicon = spark.createDataFrame([("耐用", 1)], "word STRING, polarity INT")
    found = {r["comment_id"]: r["sentiment"] for r in label_sentiment(comments, lexicon).collect()}
    assert found == {1: "positive", 2: "negative", 3: "neutral"}


def test_columns_can_be_carried(spark):
    comments = spark.createDataFrame(
        [(1, "good", "f"), (2, "bad", None)], "comment_id BIGINT, content STRING, gender STRING"
    )
    lexicon = spark.createDataFrame(LEXICON, "word STRING, polarity INT")
    rows = label_sentiment(comments, lexicon, NEGATIONS, carry=["gender"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "f", "positive"), (2, None, "negative")]


def test_lexicon_keeps_words_of_one_class(spark):
    corpus = spark.createDataFrame(
        [("Good good shared", 1), ("bad shared", 0), ("bad rare", 0), (None, 1)], "review STRING, label INT"
    )
    counts = {tuple(r) for r in class_word_counts(corpus).collect()}
    assert counts == {("good", 2, 0), ("shared", 1, 1), ("bad", 0, 2), ("rare", 0, 1)}
    lexicon = {(r["word"], r["polarity"]) for r in build_lexicon(corpus).collect()}
    assert lexicon == {("good", 1), ("bad", -1), ("rare", -1)}
    frequent = {(r["word"], r["polarity"]) for r in build_lexicon(corpus, min_freq=2).collect()}
    assert frequent == {("good", 1), ("bad", -1)}
    common = {(r["word"], r["polarity"], r["freq"]) for r in build_lexicon(corpus, keep_common=True).collect()}
    assert ("shared", 0, 2) in common


def test_head_is_within_the_bound_and_nothing_is_lost(spark):
    rows = [(f"w{i}", 1, i + 1) for i in range(100)]
    table = spark.createDataFrame(rows, "word STRING, weight INT, freq BIGINT")
    head, tail = lookup.split_by_size(table, lookup.Bound(rows=60))
    head_words, tail_words = ({r["word"] for r in part.collect()} for part in (head, tail))
    assert 0 < len(head_words) <= 60 and not head_words & tail_words
    assert len(head_words | tail_words) == 100
    assert min(r["freq"] for r in head.collect()) > max(r["freq"] for r in tail.collect())
    assert lookup.split_by_size(table, lookup.Bound(rows=100))[1] is None
    assert lookup.split_by_size(table, lookup.Bound(bytes=10))[0].count() == 0
