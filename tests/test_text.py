from pyspark.sql import functions as F

from hearsay.functions import text as txt
from hearsay.plans import words


def tokens(spark, text, **options):
    df = spark.createDataFrame([(text,)], "content STRING")
    return df.select(txt.words(F.col("content"), **options).alias("w")).first()["w"]


def test_letters_form_lower_cased_words(spark):
    assert tokens(spark, "Élève, Straße!\n2024 déjà-vu") == ["élève", "straße", "déjà", "vu"]


def test_empty_and_null_text_have_no_words(spark):
    assert tokens(spark, "") == []
    assert tokens(spark, " ,.! ") == []
    assert tokens(spark, None) == []


def test_han_runs_become_pairs(spark):
    assert tokens(spark, "小米手机很好", known=()) == ["小米", "米手", "手机", "机很", "很好"]
    assert tokens(spark, "好", known=()) == ["好"]


def test_known_han_words_are_cut_out(spark):
    assert tokens(spark, "手机不好用") == ["手机", "不好", "用"]
    assert tokens(spark, "手机不耐用") == ["手机", "不", "耐用"]
    assert tokens(spark, "不会卡顿") == ["不会", "卡顿"]


def test_a_dictionary_can_be_plugged_in(spark):
    assert tokens(spark, "特别好看的手机", known=["特别", "好看", "的"]) == ["特别", "好看", "的", "手机"]


def test_scripts_can_be_mixed(spark):
    assert tokens(spark, "MIUI系统升级 so nice", known=()) == ["miui", "系统", "统升", "升级", "so", "nice"]


def test_stop_words_go_and_repeats_stay(spark):
    df = spark.createDataFrame([(["a", "the", "a", " ", "", "the "],)], "w ARRAY<STRING>")
    kept = df.select(txt.drop_stop_words(F.col("w"), ["the"]).alias("k")).first()["k"]
    assert kept == ["a", "a"]


def test_previous_word_and_closing_entry(spark):
    df = spark.createDataFrame([(["x", "y"],), ([],)], "w ARRAY<STRING>")
    rows = [row["p"] for row in df.select(txt.with_previous(F.col("w")).alias("p")).collect()]
    assert [tuple(e) for e in rows[0]] == [("x", ""), ("y", "x"), (None, "y")]
    assert [tuple(e) for e in rows[1]] == [(None, "")]


def test_word_count_of_lines(spark):
    lines = ["Hello Spark", "Spark is awesome", "Hello world", "Apache Spark"]
    df = spark.createDataFrame([(line,) for line in lines], "value STRING")
    counted = {row["word"]: row["count"] for row in words.word_count(df).collect()}
    assert counted == {"Hello": 2, "Spark": 3, "is": 1, "awesome": 1, "world": 1, "Apache": 1}


def test_word_count_keeps_empty_words_between_spaces(spark):
    df = spark.createDataFrame([("a  b",)], "value STRING")
    counted = {row["word"]: row["count"] for row in words.word_count(df).collect()}
    assert counted == {"a": 1, "": 1, "b": 1}


def test_frequent_words_with_polarity(spark):
    texts = spark.createDataFrame([("good good bad the the the meh",)], "content STRING")
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1), ("unseen", 1)], "word STRING, polarity INT")
    rows = words.frequent_words(texts, lexicon, n=2, stop_words=["the"]).collect()
    assert [tuple(r) for r in rows] == [("good", 2, "positive"), ("bad", 1, "negative")]
    everything = words.frequent_words(texts, lexicon, n=50, stop_words=["the"]).collect()
    assert [tuple(r) for r in everything][2] == ("meh", 1, "neutral") and len(everything) == 3


def test_all_patterns_agree_where_they_overlap(spark):
    """ASCII, other alphabetic and Han texts take different patterns."""
    plain = "Some words, 2 of them; MIXED-case"
    expected = ["some", "words", "of", "them", "mixed", "case"]
    assert tokens(spark, plain) == expected
    assert tokens(spark, plain + " é") == [*expected, "é"]
    assert tokens(spark, plain + " 好") == [*expected, "好"]
    assert tokens(spark, plain + " ひ😀") == [*expected, "ひ"]
