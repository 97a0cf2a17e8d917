import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hearsay import fixtures as fx
from hearsay.functions import text as txt
from hearsay.operators import lookup
from hearsay.plans import forecast, learning
from hearsay.sources import results

START = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def corpus(spark):
    """Short texts whose words lean to one class."""
    rng = random.Random(3)
    names = "alpha beta gamma delta omega sigma kappa theta lambda zeta".split()
    rows = []
    for i in range(200):
        label = int(rng.random() < 0.6)
        lean = names[:7] if label else names[3:]
        rows.append((i, " ".join(rng.choices(lean, k=rng.randrange(1, 12))), label))
    rows += [(200, None, 1), (201, "", 0), (202, "unseen once", 1)]
    return spark.createDataFrame(rows, "doc_id BIGINT, review STRING, label INT").cache()


def by_id(df):
    return {r["doc_id"]: r["prediction"] for r in df.collect()}


def closed_form_matches_library(corpus):
    train, _ = learning.key_split(corpus, "doc_id")
    words = [F.col("*"), txt.words(F.col("review")).alias("words")]
    library = Pipeline(stages=[
        CountVectorizer(inputCol="words", outputCol="counts", vocabSize=1 << 22),
        IDF(inputCol="counts", outputCol="features", minDocFreq=5),
        NaiveBayes(labelCol="label", featuresCol="features", modelType="multinomial"),
    ]).fit(train.select(*words))
    expected = by_id(library.transform(corpus.select(*words)))
    got = by_id(learning.predict_bayes(learning.fit_bayes(train), corpus))
    assert got == {doc: int(value) for doc, value in expected.items()}
    return set(got.values())


def test_closed_form_bayes_is_the_library_model(corpus):
    assert closed_form_matches_library(corpus) == {0, 1}


def test_closed_form_bayes_on_the_test_documents(spark, sf_dir):
    closed_form_matches_library(fx.corpus(spark, sf_dir))


@pytest.mark.parametrize("bound", [lookup.Bound(rows=3), lookup.Bound(rows=0)])
def test_a_vocabulary_beyond_the_bound_predicts_the_same(corpus, bound):
    model = learning.fit_bayes(learning.key_split(corpus, "doc_id")[0])
    assert by_id(learning.predict_bayes(model, corpus, bound=bound)) == by_id(
        learning.predict_bayes(model, corpus)
    )


def test_labels_of_three_classes_are_made_once(spark, sf_dir, monkeypatch):
    trained, fit = [], learning.fit_classes
    monkeypatch.setattr(learning, "fit_classes", lambda train: trained.append(train) or fit(train))
    entry.nb_three_classes(spark, sf_dir)
    # The training rows are read twice, and no text is tokenised for their labels.
    assert "octet_length(" not in trained[0]._jdf.queryExecution().optimizedPlan().toString()


def test_term_statistics(spark):
    train = spark.createDataFrame([("a a b", 1), ("a c", 0), (None, 0)], "review STRING, label INT")
    rows = {tuple(r) for r in learning.term_statistics(train).collect()}
    assert {r for r in rows if r[0]} == {("a", 1, 2, 2), ("b", 0, 1, 1), ("c", 1, 0, 1)}
    assert {r[1:3] for r in rows if r[0] is None} == {(2, 1)}


def test_an_empty_corpus_is_an_error(corpus):
    empty = corpus.limit(0)
    for fit in (learning.fit_bayes, learning.fit_hashed_bayes, learning.hash_split):
        with pytest.raises(learning.EmptyCorpusError):
            fit(empty)


def hashed_by_hand(train, texts, buckets, min_df=5):
    """Multinomial Bayes on hashed tf-idf, with the library's bucket of a word only."""
    bucket = HashingTF(numFeatures=buckets).indexOf
    counted = [(label, Counter(bucket(w) for w in words)) for words, label in train]
    df = Counter(b for _, c in counted for b in c)
    idf = {b: math.log((len(train) + 1) / (n + 1)) for b, n in df.items() if n >= min_df}
    mass = {c: np.zeros(buckets) for c in (0, 1)}
    for label, counts in counted:
        for b, n in counts.items():
            mass[label][b] += n * idf.get(b, 0.0)
    prior = {c: math.log(sum(y == c for y, _ in counted) + 1) for c in (0, 1)}
    theta = {c: np.log(mass[c] + 1) - math.log(mass[c].sum() + buckets) for c in (0, 1)}

    def score(words, c):
        return prior[c] + sum(idf.get(bucket(w), 0.0) * theta[c][bucket(w)] for w in words)

    return [int(score(words, 1) > score(words, 0)) for words in texts]


def test_hashed_bayes_is_the_model_by_hand(corpus):
    train, test = learning.hash_split(corpus, test_share=0.3)
    assert train.count() + test.count() == corpus.count()
    tokens = lambda df: df.select("doc_id", txt.words(F.col("review")).alias("w"), "label").orderBy("doc_id")
    everything = tokens(corpus).collect()
    expected = hashed_by_hand([(r["w"], r["label"]) for r in tokens(train).collect()],
                              [r["w"] for r in everything], 16)
    model = learning.fit_hashed_bayes(train, num_features=16)
    got = by_id(learning.predict_hashed(model, corpus))
    assert [got[r["doc_id"]] for r in everything] == expected
    assert set(expected) == {0, 1}


def test_a_sample_is_a_part_of_the_corpus(corpus):
    train, test = learning.hash_split(corpus, fraction=0.5)
    ids = [r["doc_id"] for part in (train, test) for r in part.collect()]
    assert 0 < len(ids) == len(set(ids)) < corpus.count()


def test_the_split_does_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("review"), F.lit(1).alias("label"))
    parts = [
        [sorted(r["doc_id"] for r in part.collect()) for part in learning.hash_split(rows.repartition(n), ["doc_id"], 0.7)]
        for n in (3, 11)
    ]
    assert parts[0] == parts[1]
    assert 500 < len(parts[0][0]) < 620 and 90 < len(parts[0][1]) < 190


def test_equal_rows_are_numbered(spark):
    rows = spark.createDataFrame([("a", 1)] * 3 + [("b", 0)], "review STRING, label INT")
    assert sorted(tuple(r) for r in learning.numbered(rows).collect()) == [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 0, 1)]


def test_key_split_holds_out_one_part(corpus):
    train, test = learning.key_split(corpus, "doc_id")
    assert {r["doc_id"] % 5 for r in test.collect()} == {0}
    assert train.count() + test.count() == corpus.count()


def test_models_are_stored_and_read(spark, corpus, tmp_path):
    model = learning.fit_hashed_bayes(corpus)
    daily = history(spark, [1, 2, 4])
    for _ in range(2):  # the second write replaces the first
        paths = results.write_models({"nb": model, "lr": forecast.fit_trend_model(daily)}, str(tmp_path))
    loaded = PipelineModel.load(paths["nb"])
    assert by_id(learning.predict_hashed(loaded, corpus)) == by_id(learning.predict_hashed(model, corpus))
    assert LinearRegressionModel.load(paths["lr"]).coefficients[0] > 0


# --- evaluation ---------------------------------------------------------------


@pytest.mark.parametrize("rows", [
    [(1, 1), (1, 0), (0, 0), (0, 0), (1, 1), (0, 1)],
    [(1, 1), (1, 1), (0, 1)],  # class 0 is never predicted
    [(0, 1), (1, 0)],
    [(2, 2), (1, 2), (0, 0), (2, 1)],
])
def test_metrics_are_those_of_the_library(spark, rows):
    predicted = spark.createDataFrame(rows, "label INT, prediction INT")
    got = {r["metric"]: r["value"] for r in learning.classification_metrics(predicted).collect()}
    as_double = predicted.select(F.col("label").cast("double"), F.col("prediction").cast("double"))
    names = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall",
             "f1_score": "f1"}
    for metric, name in names.items():
        value = MulticlassClassificationEvaluator(metricName=name).evaluate(as_double)
        assert got[metric] == pytest.approx(value, abs=1e-6), metric
    assert got["evaluation_dataset_size"] == len(rows)


def test_no_predictions_have_no_metrics(spark):
    assert learning.classification_metrics(spark.createDataFrame([], "label INT, prediction INT")).count() == 0


# --- forecast -----------------------------------------------------------------


def history(spark, counts, gaps=()):
    days = [START + datetime.timedelta(days=i) for i in range(len(counts) + len(gaps)) if i not in gaps]
    rows = [(d, 0, c) for d, c in zip(days, counts, strict=True)]
    return spark.createDataFrame(rows, "date DATE, negative_count BIGINT, positive_count BIGINT")


def future(df):
    return [tuple(r) for r in df.orderBy("date").collect()]


@pytest.mark.parametrize("gaps", [(), (1, 4)])
def test_forecast_is_the_library_regression(spark, gaps):
    counts = [3, 10, 8, 15, 21, 20]
    daily = history(spark, counts, gaps)
    model = forecast.fit_trend_model(daily)
    assert isinstance(model, LinearRegressionModel) and isinstance(LinearRegression(), LinearRegression)
    last = max(r["date"] for r in daily.collect())
    expected = []
    for step in range(1, 8):
        date = last + datetime.timedelta(days=step)
        value = model.intercept + model.coefficients[0] * (date - START).days
        expected.append((date, int(round(max(value, 0), 6))))
    assert future(forecast.trend_forecast(daily)) == expected


def test_falling_trends_end_at_zero(spark):
    assert [c for _, c in future(forecast.trend_forecast(history(spark, [9, 5, 1])))][-1] == 0


@pytest.mark.parametrize("counts", [[4], [4, 4, 4]])
def test_one_day_or_equal_days_stay_as_they_are(spark, counts):
    assert {c for _, c in future(forecast.trend_forecast(history(spark, counts)))} == {4}


def test_no_history_needs_a_start_date(spark):
    empty = history(spark, [])
    assert future(forecast.trend_forecast(empty)) == []
    ahead = future(forecast.trend_forecast(empty, horizon=2, start_date="2024-02-28"))
    assert ahead == [(datetime.date(2024, 2, 29), 0), (datetime.date(2024, 3, 1), 0)]
    known = future(forecast.trend_forecast(history(spark, [4]), horizon=1, start_date="2024-02-28"))
    assert known == [(datetime.date(2024, 1, 2), 4)]


def test_positions_instead_of_days(spark):
    gaps = history(spark, [1, 2, 3], gaps=(1, 3))
    by_row = future(forecast.trend_forecast(gaps, feature="row"))
    assert by_row[0][0] == datetime.date(2024, 1, 6)
    plain = future(forecast.trend_forecast(history(spark, [1, 2, 3])))
    assert [c for _, c in by_row] == [c for _, c in plain]
    with pytest.raises(ValueError):
        forecast.trend_forecast(gaps, feature="week")


def test_daily_class_counts_leave_out_unknown_days(spark):
    rows = [("2024-01-01 10:00:00", 1), ("2024-01-01 11:00:00", 0), ("2024-01-01 12:00:00", 1), (None, 1)]
    predicted = spark.createDataFrame(rows, "created_at STRING, prediction INT").withColumn(
        "created_at", F.col("created_at").cast("timestamp")
    )
    assert future(forecast.daily_class_counts(predicted)) == [(START, 1, 2)]


def test_hourly_forecast(spark):
    rows = [(f"2024-01-01 {h:02}:30:00", h, 0, 0) for h in (20, 21, 22, 23)]
    df = spark.createDataFrame(rows, "created_at STRING, likes INT, comments INT, shares INT").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz")
    )
    ahead = forecast.hourly_forecast(df).orderBy("hour_start").collect()
    assert len(ahead) == 24 and ahead[0]["hour_start"] == datetime.datetime(2024, 1, 2, 0, 0)
    slope = 1 / (1 + 0.01 / np.std([20, 21, 22, 23]))
    assert [r["predicted_interaction"] for r in ahead[:2]] == [int(21.5 + slope * 2.5), int(21.5 + slope * 3.5)]


# --- several classes -----------------------------------------------------------


@pytest.fixture(scope="module")
def three_classes(spark):
    rng = random.Random(9)
    names = "alpha beta gamma delta omega sigma kappa theta lambda zeta".split()
    weights = {"a": range(1, 11), "b": range(10, 0, -1), "c": [5] * 10}
    rows = [(i, " ".join(rng.choices(names, weights[label], k=rng.randint(3, 12))), label)
            for i in range(240) for label in [rng.choice("aabc")]]
    return spark.createDataFrame(rows, "doc_id BIGINT, review STRING, label STRING")


def test_several_classes_match_spark_ml(spark, three_classes):
    words = three_classes.select("doc_id", F.array_position(F.array(*map(F.lit, "abc")), F.col("label")).cast("double").alias("label"),
                                 F.split("review", " ").alias("words")).withColumn("label", F.col("label") - 1)
    stages = [CountVectorizer(inputCol="words", outputCol="counts"), IDF(inputCol="counts", outputCol="features", minDocFreq=5),
              NaiveBayes(modelType="multinomial")]
    expected = {r.doc_id: "abc"[int(r.prediction)] for r in Pipeline(stages=stages).fit(words).transform(words).collect()}
    model = learning.fit_classes(three_classes)
    assert model.classes == ["a", "b", "c"]
    for bound in (lookup.DEFAULT_BOUND, lookup.Bound(rows=4, bytes=10_000), lookup.Bound(rows=0, bytes=0)):
        got = {r.doc_id: r.prediction for r in learning.predict_classes(model, three_classes, bound=bound).collect()}
        assert got == expected
    assert len(set(expected.values())) == 3


def test_two_classes_are_the_two_class_model(corpus):
    both = learning.predict_classes(learning.fit_classes(corpus), corpus).collect()
    assert sorted(both) == sorted(learning.predict_bayes(learning.fit_bayes(corpus), corpus).collect())


def test_classes_of_odd_rows(spark, three_classes):
    odd = spark.createDataFrame([(900, None, "a"), (901, "", "b"), (902, "unheard of", "c"), (903, "alpha beta", None)], three_classes.schema)
    model = learning.fit_classes(three_classes.union(odd))
    got = {r.doc_id: r.prediction for r in learning.predict_classes(model, odd).collect()}
    assert got[900] == got[901] == got[902] == "a" and got[903] in "abc"  # the most frequent class where nothing is known
    level = spark.createDataFrame([(1, "x y", 3), (2, "x y", 2)], "doc_id BIGINT, review STRING, label INT")
    assert {r.prediction for r in learning.predict_classes(learning.fit_classes(level, min_df=1), level).collect()} == {2}
    with pytest.raises(learning.EmptyCorpusError):
        learning.fit_classes(odd.filter("label IS NULL"))
    with pytest.raises(ValueError):
        learning.fit_classes(three_classes, most_classes=2)
