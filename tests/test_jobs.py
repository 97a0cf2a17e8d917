"""The batch steps end to end on small CSV files."""

import csv
import json

import pytest

from hearsay import jobs
from hearsay.sources import results

TOP = ["comment_id", "create_date_time", "content", "comments_count", "liked_count", "shared_count",
       "ip_location", "gender", "user_id", "nickname", "source_keyword"]
REPLY = ["comment_id", "create_date_time", "content", "sub_comment_count", "comment_like_count",
         "ip_location", "gender", "user_id"]


def write(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(header)
        writer.writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Raw files and the stored table made from them."""
    base = tmp_path_factory.mktemp("jobs")
    time = "2024-01-0{} 10:00:00+08:00"
    top = [
        ["1", time.format(1), "手机耐用", "1", "600", "10", "北京", "f", "u1", "n", "k"],
        ["2", time.format(2), "手机不耐用\n退货", "1", "5", "0", "中国台湾", "m", "u2", "n", "k"],
        ["2", time.format(2), "手机不耐用\n退货", "1", "5", "0", "中国台湾", "m", "u2", "n", "k"],
        ["3", time.format(2), "随便看看", "0", "1.2万", "0", "北京", "f", "u1", "n", "k"],
        ["4", time.format(3), "没有性别", "0", "1", "0", "北京", "", "u1", "n", "k"],
    ]
    replies = [["5", time.format(3), "退货", "2", "20000", "上海", "m", "u3"]]
    corpus = [["耐用", "1"], ["退货", "0"], ["手机", "1"], ["手机", "0"]] * 20
    write(base / "top.csv", TOP, top)
    write(base / "replies.csv", REPLY, replies)
    write(base / "corpus.csv", ["label", "review"], [[label, text] for text, label in corpus])
    stored = jobs.clean_comments(spark, f"{base}/top.csv", f"{base}/replies.csv", f"{base}/stored", files=2)
    assert stored == f"{base}/stored"
    return base


def rows(spark, path):
    return [json.loads(r["value"]) for r in spark.read.text(path).collect()]


def test_preview(spark, folder):
    shown = jobs.preview_comments(spark, f"{folder}/stored", 3)
    assert shown.count() == 3 and "content" in shown.columns


def test_explore_writes_every_analysis(spark, folder):
    paths = jobs.explore_comments(spark, f"{folder}/stored", f"{folder}/corpus.csv", f"{folder}/explored")
    found = {name: rows(spark, path) for name, path in paths.items()}
    assert len(found) == 23

    # The repeated comment counts twice.
    totals = {r["sentiment"]: r["count"] for r in found["sentiment_overall_counts"]}
    assert totals == {"positive": 1, "negative": 3, "neutral": 1}
    hot = {r["sentiment"]: r["count"] for r in found["hot_posts_sentiment_counts"]}
    assert hot == {"positive": 1, "negative": 1}
    assert {r["word"] for r in found["high_conversion_words"]} == {"手机", "机耐", "耐用"}  # of one comment at least
    assert found["extremely_high_likes_count"] == [{"count": 1}]
    assert {r["name"]: r["value"] for r in found["province_post_counts"]} == {"北京": 2, "台湾": 2, "上海": 1}
    assert found["event_peak"] == [{"peak_date": "2024-01-02", "peak_count": 3}]
    assert {r["gender"]: r["count"] for r in found["gender_ratio"]} == {"f": 2, "m": 3}
    words = {r["word"]: (r["count"], r["sentiment"]) for r in found["frequent_words_sentiment"]}
    assert words["退货"] == (3, "negative") and words["耐用"] == (3, "positive")
    assert words["手机"] == (3, "neutral") and "不" not in words
    best = max(found["high_conversion_content_examples"], key=lambda r: r["share_conversion_rate"])
    assert (best["content"], best["sentiment"]) == ("手机耐用", "positive")
    assert len(found["high_conversion_content_examples"]) == 5
    assert {r["user_id"]: r.get("total_interaction") for r in found["top_100_opinion_leaders"]}["u2"] == 12


def test_learn_writes_labels_metrics_forecast_and_models(spark, folder):
    paths = jobs.learn_sentiment(spark, f"{folder}/stored", f"{folder}/corpus.csv", f"{folder}/learned")
    labels = rows(spark, paths[results.ANALYSIS])
    assert len(labels) == 5 and all(
        set(r) == {"row_id", "created_at", "content", "date", "sentiment_label"} for r in labels)
    assert len({r["row_id"] for r in labels}) == 5
    assert {r["model_type"] for r in rows(spark, paths[results.EVALUATION])} == {"NaiveBayes Classifier"}
    by_text = {r["content"]: r["sentiment_label"] for r in labels}
    assert by_text["手机耐用"] == 1 and by_text["退货"] == 0
    assert {r["metric"] for r in rows(spark, paths[results.EVALUATION])} == {
        "accuracy", "precision", "recall", "f1_score", "evaluation_dataset_size"
    }
    ahead = rows(spark, paths[results.TREND])
    assert sorted(r["date"] for r in ahead) == [f"2024-01-{d:02}" for d in range(4, 11)]
    assert {"naive_bayes_model", "linear_regression_model"} <= set(paths)


def test_drop_columns(spark, folder):
    missing = jobs.drop_csv_columns(spark, f"{folder}/top.csv", f"{folder}/dropped")
    assert "avatar" in missing and "user_id" not in missing
    kept = spark.read.csv(f"{folder}/dropped", header=True, multiLine=True)
    assert kept.columns == [c for c in TOP if c not in {"comment_id", "user_id", "nickname"}]
    assert kept.count() == 5


def test_command_line(spark, folder, capsys):
    jobs.main(["clean", "--top-level", f"{folder}/top.csv", "--replies", f"{folder}/replies.csv",
               "--out", f"{folder}/again", "--sub-dir", "x"])
    assert capsys.readouterr().out.strip().endswith("/again/x")
    with pytest.raises(SystemExit):
        jobs.main(["clean"])
