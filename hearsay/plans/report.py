"""The complete set of analyses of one comment table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions import text as txt
from hearsay.operators.sentiment import label_sentiment
from hearsay.operators.spool import spool
from hearsay.plans import forecast, interaction, totals, volume, words
from hearsay.schemas import COUNT_COLUMNS, SENTIMENTS
from hearsay.vocabulary import NEGATIONS, PROVINCE_ALIASES, STOP_WORDS

NARROW = ("user_id", "created_at", "likes", "comments", "shares", "ip_location", "gender")


def explore(
    comments: DataFrame,
    lexicon: DataFrame,
    stop_words: Iterable[str] = STOP_WORDS,
    negations: Iterable[str] = NEGATIONS,
    aliases: Mapping[str, str] = PROVINCE_ALIASES,
    tokenizer: txt.Tokenizer = txt.words,
    tz: str | None = None,
    key: str = "comment_id",
    texts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All exploratory analyses under their result names.

    The texts are read once for sentiment and once for words.  What that leaves, a
    narrow table of labels and one of word totals, is kept in files.  The labels are read four times
    in all: once for the totals of all groups, once for the values of percentiles and rates, for the
    comments at the rate that ends the top decile, and for the examples.  ``key`` tells the comments apart.

    Where many comments have one text, give ``texts(doc_id, content)`` and a ``doc_id`` in place of
    ``content`` in ``comments``: each text is then split and labelled once.
    """
    lexicon = spool(lexicon, "lexicon")
    carry = [c for c in NARROW if c in comments.columns]
    if texts is None:
        labels = label_sentiment(comments.select(key, "content", *carry), lexicon, negations, carry, tokenizer, key=key)
    else:
        by_text = label_sentiment(texts, lexicon, negations, (), tokenizer, key="doc_id")
        labels = comments.select(key, "doc_id", *carry).join(by_text, "doc_id")
    labelled = spool(labels, "labelled")
    values = spool(interaction.counted_rates(labelled, COUNT_COLUMNS), "values")
    high = interaction.is_high_conversion(labelled, key=key, counts=values)
    if texts is None:
        tokens = words.occurrences(comments.select(key, "content", high.alias("high")), stop_words, tokenizer, carry=["high"])
        found = tokens.groupBy("word").agg(F.count("*").alias("count"), F.count_if("high").alias("high"))
    else:
        # A text meets the number of its comments, and then its words weigh as much.  Words by text are many
        # times the rows of the texts: they are never shuffled, only totals by word are.
        uses = labelled.groupBy("doc_id").agg(F.count("*").alias("uses"), F.count_if(high).alias("high"))
        used = texts.select("doc_id", "content").join(uses.hint("shuffle_hash"), "doc_id")
        found = words.occurrences(used, stop_words, tokenizer, carry=["uses", "high"]).groupBy("word").agg(
            F.sum("uses").alias("count"), F.sum("high").alias("high"))
    word_totals = spool(found, "words")
    grouped = spool(totals.totals(labelled, tz), "totals")
    of = lambda name: totals.of(grouped, name)
    whole, places, genders = of("all"), of("place"), of("gender")
    per_class = [F.col(s) for s in SENTIMENTS]
    rounded = [F.round(f"avg_{c}", 2).alias(f"avg_{c}") for c in COUNT_COLUMNS]
    results = {
        "sentiment_overall_counts": of("sentiment").select("sentiment", "count"),
        "hot_posts_sentiment_counts": of("sentiment").filter("hot > 0").select("sentiment", F.col("hot").alias("count")),
        "interaction_percentiles": interaction.percentiles_of(values.filter("metric <> 'rate'")),
        "extremely_high_likes_count": whole.agg(F.coalesce(F.sum("extreme"), F.lit(0)).alias("count")),
        "posts_per_hour": of("hour_of_day").select("post_hour", "count").orderBy("post_hour"),
        "posts_per_day": of("day").select("date", "count").orderBy("date"),
        "event_peak": volume.peak_of(of("day").select("date", "count")),
        "event_stages": volume.stages_of(of("day").select("date", "count")),
        "ip_location_counts": places.select("ip_location", "count").orderBy(F.desc("count"), "ip_location"),
        "province_post_counts": volume.provinces_of(places, aliases),
        "gender_ratio": volume.shares_of(genders.select("gender", "count")),
        "interaction_per_gender": genders.select("gender", *rounded),
        "sentiment_per_gender": genders.select("gender", *per_class),
        "sentiment_per_ip_location": places.select("ip_location", *per_class),
        "shares_by_ip_location": places.select("ip_location", "total_shares").orderBy(F.desc("total_shares"), "ip_location"),
        "average_share_conversion_rate": whole.agg(F.round(F.max("avg_rate"), 4).alias("average_rate")),
        "high_conversion_content_examples": conversion_examples(labelled, comments if texts is None else texts, key=key),
        "high_conversion_words": words.most_frequent(
            word_totals.filter(F.col("high") > 0).select("word", F.col("high").alias("count"))
        ),
        "interaction_prediction": forecast.hourly_forecast_of(of("hour").select(F.col("hour").alias("x"), F.col("interaction").alias("y"))),
        "sentiment_over_time": of("day").select("date", *per_class).orderBy("date"),
        "frequent_words_sentiment": words.with_polarity(word_totals, lexicon),
    }
    if "user_id" in carry:
        results["avg_posts_per_gender"] = totals.posts_per_user(of("user"))
        results["top_100_opinion_leaders"] = totals.top_users(of("user"))
    return results


def conversion_examples(
    labelled: DataFrame, texts: DataFrame, n: int = 10, key: str = "comment_id"
) -> DataFrame:
    """``key, content, sentiment, share_conversion_rate`` of the ``n`` highest rates.

    Ranking reads no text; the ``n`` rows found are the broadcast side of the lookup.
    """
    by = key if key in texts.columns else "doc_id"
    top = interaction.top_conversion(labelled, n, carry=["sentiment", *({by} - {key})], key=key)
    found = texts.select(by, "content").join(F.broadcast(top), by)
    return found.select(key, "content", "sentiment", "share_conversion_rate")
