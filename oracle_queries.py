"""Independent SQL (DuckDB) for the registered queries, on the same Parquet tables."""

from __future__ import annotations

from hearsay.fixtures import ALIASES, BUCKETS, HAN, LATIN, NEGATIONS, STOP_WORDS
from hearsay.functions.text import KNOWN_WORDS
from hearsay.plans import han
from hearsay.vocabulary import NEGATIONS as FULL_NEGATIONS
from hearsay.vocabulary import STOP_WORDS as FULL_STOP_WORDS


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}]+'), lambda x: x <> '')"


_NEG, _STOP = _listed(NEGATIONS), _listed(STOP_WORDS)

COMMENTS = """comments AS (
  SELECT e.event_id AS comment_id, d.doc_id, e.user_id, e.ts AS created_at, d.text AS content,
         CASE WHEN e.event_id % 3 = 0 THEN 2 ELSE 1 END AS level,
         CAST(floor(e.value * e.value / 10) AS BIGINT) AS likes,
         CAST(regexp_extract(e.props, '[0-9]+', 0) AS BIGINT) AS comments,
         CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE CAST(floor(e.value) AS BIGINT) END AS shares,
         n.n_name AS ip_location,
         CASE e.user_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' ELSE NULL END AS gender
  FROM events e
  JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
  JOIN nation n ON n.n_nationkey = e.user_id % 25)"""

DAILY = """daily AS (
  SELECT CAST(created_at AS DATE) AS date, count(*) AS count FROM comments GROUP BY 1),
peak AS (SELECT date, count FROM daily ORDER BY count DESC, date LIMIT 1)"""

CORPUS = """corpus AS (
  SELECT d.doc_id, d.text AS review, l.quality AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

LEXICON = f"""{CORPUS},
corpus_words AS (SELECT label, unnest({_words('review')}) AS word FROM corpus),
class_counts AS (
  SELECT word, count(*) FILTER (WHERE label = 1) AS positive,
         count(*) FILTER (WHERE label = 0) AS negative
  FROM corpus_words GROUP BY word),
lexicon AS (
  SELECT word, CASE WHEN positive > 0 THEN 1 ELSE -1 END AS polarity
  FROM class_counts WHERE (positive > 0) <> (negative > 0))"""

DOC_LABELS = f"""{LEXICON},
positions AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS position
  FROM (SELECT doc_id, {_words('text')} AS words FROM documents)),
neighbours AS (
  SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY position) AS previous
  FROM positions),
scores AS (
  SELECT doc_id, sum(CASE WHEN t.word IN ({_NEG}) THEN 0
                          WHEN previous IN ({_NEG}) THEN -polarity ELSE polarity END) AS score
  FROM neighbours t LEFT JOIN lexicon x ON x.word = t.word GROUP BY doc_id),
doc_labels AS (
  SELECT d.doc_id, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative'
                        ELSE 'neutral' END AS sentiment
  FROM documents d LEFT JOIN scores s ON s.doc_id = d.doc_id)"""

LABELLED = f"""{COMMENTS}, {DOC_LABELS},
labelled AS (SELECT c.*, l.sentiment FROM comments c JOIN doc_labels l ON l.doc_id = c.doc_id)"""

RATE = """CASE WHEN likes + comments + shares > 0
               THEN shares / (likes + comments + shares) ELSE 0.0 END"""

def _bayes(train: str, tokens, size: str = "count(*)") -> str:
    """``predicted(doc_id, prediction)``; ``tokens`` makes a list of words of a text column."""
    return f"""{CORPUS},
train AS (SELECT * FROM corpus WHERE {train}),
test AS (SELECT * FROM corpus WHERE NOT ({train})),
train_words AS (SELECT doc_id, label, unnest({tokens('review')}) AS word FROM train),
sizes AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS n1,
         count(*) FILTER (WHERE label = 0) AS n0 FROM train),
terms AS (
  SELECT word, count(*) FILTER (WHERE label = 1) AS tf1, count(*) FILTER (WHERE label = 0) AS tf0,
         CASE WHEN count(DISTINCT doc_id) < 5 THEN 0
              ELSE ln((max(n) + 1) / (count(DISTINCT doc_id) + 1)) END AS idf
  FROM train_words, sizes GROUP BY word),
masses AS (
  SELECT sum(tf1 * idf) + {size} AS m1, sum(tf0 * idf) + {size} AS m0 FROM terms),
model AS (
  SELECT word, idf, ln(tf1 * idf + 1) - ln(m1) AS theta1, ln(tf0 * idf + 1) - ln(m0) AS theta0
  FROM terms, masses),
all_words AS (SELECT doc_id, unnest({tokens('text')}) AS word FROM documents),
odds AS (
  SELECT w.doc_id, sum(idf * (theta1 - theta0)) AS odds
  FROM all_words w JOIN model m ON m.word = w.word GROUP BY w.doc_id),
predicted AS (
  SELECT d.doc_id,
         CAST(CASE WHEN round(coalesce(odds, 0) + ln(n1 + 1) - ln(n0 + 1), 6) > 0
                   THEN 1 ELSE 0 END AS INT) AS prediction
  FROM documents d CROSS JOIN sizes LEFT JOIN odds o ON o.doc_id = d.doc_id)"""


def _place(salt: str) -> str:
    return f"('0x' || substr(md5('{salt}42|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _buckets(text: str) -> str:
    return f"""list_transform({_words(text)},
    lambda w: 'b' || (('0x' || substr(md5(w), 1, 8))::BIGINT % {BUCKETS}))"""


PREDICTED = _bayes("doc_id % 5 <> 0", _words)
_SAMPLED = f"{_place('sample')} < 0.7"
_HASHED = _bayes(f"{_SAMPLED} AND {_place('test')} >= 0.2", _buckets, str(BUCKETS))
_PIPELINE = _bayes(f"{_SAMPLED} AND {_place('test')} >= 0.2", _buckets, str(1 << 18))

EVALUATED = f"""{PREDICTED},
outcomes AS (SELECT t.label, p.prediction FROM test t JOIN predicted p ON p.doc_id = t.doc_id),
classes AS (
  SELECT c.class, count(*) FILTER (WHERE label = class) AS actual,
         count(*) FILTER (WHERE prediction = class) AS claimed,
         count(*) FILTER (WHERE label = class AND prediction = class) AS hits
  FROM outcomes, (VALUES (0), (1)) c(class) GROUP BY c.class),
evaluation AS (
  SELECT 'accuracy' AS metric, round(sum(hits) / sum(actual), 6) AS value FROM classes
  UNION ALL SELECT 'precision', round(sum(actual * CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END)
                                      / sum(actual), 6) FROM classes
  UNION ALL SELECT 'recall', round(sum(hits) / sum(actual), 6) FROM classes
  UNION ALL SELECT 'f1_score', round(sum(actual * CASE WHEN actual + claimed > 0
                     THEN 2.0 * hits / (actual + claimed) ELSE 0.0 END) / sum(actual), 6) FROM classes
  UNION ALL SELECT 'evaluation_dataset_size', CAST(sum(actual) AS DOUBLE) FROM classes)"""

CLASS_DAYS = f"""{COMMENTS}, {PREDICTED},
class_days AS (
  SELECT CAST(c.created_at AS DATE) AS date,
         count(*) FILTER (WHERE prediction = 0) AS negative_count,
         count(*) FILTER (WHERE prediction = 1) AS positive_count
  FROM comments c JOIN predicted p ON p.doc_id = c.doc_id GROUP BY 1)"""


def _han(text: str) -> str:
    """Words of a text in Han characters: known words, pairs of the rest, and other letters."""
    known = sorted((w for w in KNOWN_WORDS), key=lambda w: (-len(w), w))
    cut = f"regexp_replace(translate(lower({text}), '{LATIN}', '{HAN}'), '({'|'.join(known)})', ' \\1 ', 'g')"
    cut = f"regexp_replace({cut}, '(\\p{{Han}}+)', ' \\1 ', 'g')"
    listed = f"list_filter(string_split_regex({cut}, '[^\\p{{L}}]+'), lambda w: w <> '')"
    return f"""flatten(list_transform({listed}, lambda w:
  CASE WHEN regexp_full_match(w, '\\p{{Han}}{{3,}}') AND NOT list_contains([{_listed(KNOWN_WORDS)}], w)
       THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END))"""


_HAN_NEG, _HAN_STOP = _listed(FULL_NEGATIONS), ", ".join("'" + w.replace("'", "''") + "'" for w in FULL_STOP_WORDS)
_HAN_DOCS = f"""docs AS MATERIALIZED (SELECT doc_id, {_han('text')} AS words FROM documents)"""
_HAN_LEXICON = f"""{_HAN_DOCS},
class_counts AS (
  SELECT word, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative
  FROM (SELECT l.quality AS label, unnest(words) AS word FROM docs d JOIN labels l ON l.doc_id = d.doc_id)
  GROUP BY word),
lexicon AS (
  SELECT word, CASE WHEN positive > 0 THEN 1 ELSE -1 END AS polarity
  FROM class_counts WHERE (positive > 0) <> (negative > 0))"""


def _fit(history: str) -> str:
    """Ridge fit of ``history(x, y)``: slope shrunk by 1 + 0.01 / stddev_pop(y)."""
    return f"""fit AS (
  SELECT CASE WHEN stddev_pop(y) > 0
              THEN coalesce(regr_slope(y, x) / (1 + 0.01 / stddev_pop(y)), 0) ELSE 0 END AS slope,
         avg(x) AS mean_x, avg(y) AS mean_y, max(x) AS last_x
  FROM ({history}))"""


def _ahead(steps: int) -> str:
    return f"""(SELECT i, last_x + i AS x,
       greatest(round(mean_y + slope * (last_x + i - mean_x), 6), 0) AS predicted
FROM fit, range(1, {steps + 1}) r(i))"""


def _by(key: str) -> str:
    return f"""WITH {LABELLED} SELECT {key}, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral FROM labelled GROUP BY {key}"""


def _decile(comments: str = "comments") -> str:
    return f"""ranked AS (
  SELECT comment_id, content, row_number() OVER (ORDER BY {RATE} DESC, comment_id) AS place,
         count(*) OVER () AS n FROM {comments}),
high AS (SELECT * FROM ranked WHERE place <= greatest(floor(0.1 * n), 1))"""


# Shares are 0 for 95 of 100 comments.
_TIED = """tied AS (
  SELECT * REPLACE (CASE WHEN comment_id % 20 = 1 THEN shares ELSE 0 END AS shares) FROM comments)"""

_NOT_NULL = """created_at IS NOT NULL AND content IS NOT NULL AND likes IS NOT NULL AND comments IS NOT NULL
  AND shares IS NOT NULL AND ip_location IS NOT NULL AND gender IS NOT NULL"""

_CLEAN = f"""WITH {COMMENTS}
SELECT comment_id, created_at, content, likes, comments, shares, ip_location, gender
FROM comments WHERE {_NOT_NULL}"""

_TREND = f"""WITH {CLASS_DAYS}, {_fit("SELECT date_diff('day', (SELECT min(date) FROM class_days), date) AS x, positive_count AS y FROM class_days")}
SELECT CAST((SELECT max(date) FROM class_days) + CAST(i AS INT) AS DATE) AS date,
       CAST(trunc(predicted) AS INT) AS predicted_positive_count FROM {_ahead(7)}"""

_TREND_ROW = f"""WITH {CLASS_DAYS}, {_fit("SELECT row_number() OVER (ORDER BY date) - 1 AS x, positive_count AS y FROM class_days")}
SELECT CAST((SELECT max(date) FROM class_days) + CAST(i AS INT) AS DATE) AS date,
       CAST(trunc(predicted) AS INT) AS predicted_positive_count FROM {_ahead(7)}"""

_HOURS = """SELECT date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', created_at)) AS x,
       CAST(sum(CAST(likes AS BIGINT) + comments + shares) AS BIGINT) AS y FROM comments GROUP BY 1"""

_PROFILE = [
    "comment_id", "user_id", "created_at", "level", "likes", "comments", "shares", "ip_location", "gender",
]

_FREQUENT = f"""tokens AS (SELECT unnest({_words('text')}) AS word FROM documents),
frequent AS (
  SELECT word, count(*) AS count FROM tokens WHERE word NOT IN ({_STOP})
  GROUP BY word ORDER BY count DESC, word LIMIT 50)"""

SQL: dict[str, str] = {
    "clean_merge": _CLEAN,
    "stored_roundtrip": _CLEAN,
    "null_drop_audit": f"""WITH {COMMENTS}, kept AS (SELECT * FROM comments WHERE {_NOT_NULL})
SELECT stage, rows_in, rows_out, rows_in - rows_out AS rows_dropped FROM (
  SELECT 'level1' AS stage, (SELECT count(*) FROM comments WHERE level = 1) AS rows_in,
         (SELECT count(*) FROM kept WHERE level = 1) AS rows_out
  UNION ALL SELECT 'level2', (SELECT count(*) FROM comments WHERE level = 2),
         (SELECT count(*) FROM kept WHERE level = 2)
  UNION ALL SELECT 'merged', (SELECT count(*) FROM kept), (SELECT count(*) FROM kept))""",
    "table_profile": f"WITH {COMMENTS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS "rows", count({c}) AS non_null FROM comments"""
        for c in _PROFILE
    ),
    "table_preview": f"""WITH {COMMENTS} SELECT comment_id, created_at, content, likes
FROM comments ORDER BY comment_id LIMIT 5""",
    "csv_roundtrip": f"""WITH {COMMENTS}
SELECT comment_id, date_trunc('second', created_at) AS created_at, content, likes, comments, shares,
       ip_location, gender FROM comments WHERE level = 1""",
    "csv_spread": f"""WITH {COMMENTS} SELECT comment_id, content, likes FROM comments WHERE level = 1 UNION ALL
SELECT -1, 'open "said" ' || (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) FROM nation), NULL""",
    "json_documents": f"""WITH {COMMENTS}
SELECT comment_id, CAST(created_at AS DATE) AS date, concat('{{["\\', ip_location, '"}}, {{', chr(9)) AS ip_location, likes FROM comments""",
    "json_tolerant_read": f"""WITH {COMMENTS}
SELECT comment_id, CAST(created_at AS DATE) AS date, ip_location, likes FROM comments""",
    "posts_per_hour": f"""WITH {COMMENTS}
SELECT CAST(hour(created_at) AS INT) AS post_hour, count(*) AS count FROM comments GROUP BY 1""",
    "posts_per_hour_local": f"""WITH {COMMENTS}
SELECT CAST(hour(created_at + INTERVAL 8 HOUR) AS INT) AS post_hour, count(*) AS count
FROM comments GROUP BY 1""",
    "posts_per_day": f"WITH {COMMENTS}, {DAILY} SELECT date, count FROM daily",
    "event_peak": f"WITH {COMMENTS}, {DAILY} SELECT date AS peak_date, count AS peak_count FROM peak",
    "event_stages": f"""WITH {COMMENTS}, {DAILY}
SELECT d.date, d.count, CASE WHEN d.date < p.date THEN 'onset' WHEN d.date = p.date THEN 'climax'
                             ELSE 'calm' END AS stage FROM daily d, peak p""",
    "ip_location_counts": f"WITH {COMMENTS} SELECT ip_location, count(*) AS count FROM comments GROUP BY 1",
    "province_post_counts": f"""WITH {COMMENTS}, aliases(source, target) AS (VALUES {
        ', '.join(f"('{a}', '{b}')" for a, b in ALIASES.items())})
SELECT coalesce(target, ip_location) AS name, count(*) AS value
FROM comments LEFT JOIN aliases ON source = ip_location GROUP BY 1""",
    "gender_ratio": f"""WITH {COMMENTS} SELECT gender, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (), 4) AS share FROM comments GROUP BY gender""",
    "interaction_per_gender": f"""WITH {COMMENTS} SELECT gender, round(avg(likes), 2) AS avg_likes,
       round(avg(comments), 2) AS avg_comments, round(avg(shares), 2) AS avg_shares
FROM comments GROUP BY gender""",
    "posts_per_user_by_gender": f"""WITH {COMMENTS}
SELECT gender, round(count(*) / count(DISTINCT user_id), 4) AS avg_posts FROM comments GROUP BY gender""",
    "interaction_p99": f"WITH {COMMENTS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, round(quantile_cont({c}, 0.99), 2) AS p99 FROM comments"
        for c in ("likes", "comments", "shares")
    ),
    "extreme_likes_count": f"WITH {COMMENTS} SELECT count(*) AS count FROM comments WHERE likes > 10000",
    "shares_by_location": f"""WITH {COMMENTS}
SELECT ip_location, CAST(sum(shares) AS BIGINT) AS total_shares FROM comments GROUP BY 1""",
    "avg_share_conversion": f"WITH {COMMENTS} SELECT round(avg({RATE}), 4) AS average_rate FROM comments",
    "top_share_conversion": f"""WITH {LABELLED}
SELECT comment_id, content, sentiment, round({RATE}, 6) AS share_conversion_rate
FROM labelled ORDER BY {RATE} DESC, comment_id LIMIT 10""",
    "top_opinion_leaders": f"""WITH {COMMENTS}
SELECT user_id, CAST(sum(CAST(likes AS BIGINT) + comments + shares) AS BIGINT) AS total_interaction
FROM comments GROUP BY user_id ORDER BY total_interaction DESC, user_id LIMIT 100""",
    "tokens": f"""SELECT doc_id AS comment_id, len(words) AS n_words,
       len(list_filter(words, lambda x: x NOT IN ({_STOP}))) AS n_tokens
FROM (SELECT doc_id, {_words('text')} AS words FROM documents)""",
    "word_count": """SELECT word, count(*) AS count
FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS word FROM documents) GROUP BY word""",
    "corpus_word_counts": f"WITH {LEXICON} SELECT word, positive, negative FROM class_counts",
    "lexicon": f"WITH {LEXICON} SELECT word, CAST(polarity AS INT) AS polarity FROM lexicon",
    "lexicon_min_freq": f"""WITH {LEXICON}
SELECT word, CAST(CASE WHEN positive >= 3 THEN 1 ELSE -1 END AS INT) AS polarity
FROM class_counts WHERE (positive >= 3) <> (negative >= 3)""",
    "sentiment_labels": f"WITH {DOC_LABELS} SELECT doc_id AS comment_id, sentiment FROM doc_labels",
    "sentiment_overall": f"WITH {LABELLED} SELECT sentiment, count(*) AS count FROM labelled GROUP BY 1",
    "sentiment_hot": f"""WITH {LABELLED}
SELECT sentiment, count(*) AS count FROM labelled WHERE likes > 500 GROUP BY 1""",
    "sentiment_by_gender": _by("gender"),
    "sentiment_by_location": _by("ip_location"),
    "sentiment_over_time": f"""WITH {LABELLED}
SELECT CAST(created_at AS DATE) AS date, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral FROM labelled GROUP BY 1""",
    "frequent_words_sentiment": f"""WITH {LEXICON}, {_FREQUENT}
SELECT f.word, f.count, CASE polarity WHEN 1 THEN 'positive' WHEN -1 THEN 'negative'
                                      ELSE 'neutral' END AS sentiment
FROM frequent f LEFT JOIN lexicon x ON x.word = f.word""",
    "conversion_top_words": f"""WITH {COMMENTS}, {_decile()}
SELECT word, count(*) AS count FROM (SELECT unnest({_words('content')}) AS word FROM high)
WHERE word NOT IN ({_STOP}) GROUP BY word ORDER BY count DESC, word LIMIT 50""",
    "high_conversion_ids": f"WITH {COMMENTS}, {_decile()} SELECT comment_id FROM high",
    "high_conversion_ties": f"WITH {COMMENTS}, {_TIED}, {_decile('tied')} SELECT comment_id FROM high",
    "sampled_split": f"""WITH {CORPUS} SELECT doc_id, CASE WHEN {_place('test')} < 0.2 THEN 'test' ELSE 'train' END AS part
FROM corpus WHERE {_SAMPLED}""",
    "nb_hashed_buckets": f"WITH {_HASHED} SELECT doc_id, prediction FROM predicted",
    "nb_hashed_pipeline": f"WITH {_PIPELINE} SELECT doc_id, prediction FROM predicted",
    "model_roundtrip": """SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS changed FROM documents""",
    "han_tokens": f"""WITH {_HAN_DOCS} SELECT doc_id AS comment_id, len(words) AS n_words,
       len(list_filter(words, lambda w: w NOT IN ({_HAN_STOP}))) AS n_tokens FROM docs""",
    "han_sentiment_labels": f"""WITH {_HAN_LEXICON},
neighbours AS (
  SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY position) AS previous
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS position FROM docs)),
scores AS (
  SELECT doc_id, sum(CASE WHEN t.word IN ({_HAN_NEG}) THEN 0
                          WHEN previous IN ({_HAN_NEG}) THEN -polarity ELSE polarity END) AS score
  FROM neighbours t LEFT JOIN lexicon x ON x.word = t.word GROUP BY doc_id)
SELECT d.doc_id AS comment_id, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative'
                                    ELSE 'neutral' END AS sentiment
FROM documents d LEFT JOIN scores s ON s.doc_id = d.doc_id""",
    "han_frequent_words": f"""WITH {_HAN_LEXICON},
frequent AS (
  SELECT word, count(*) AS count FROM (SELECT unnest(words) AS word FROM docs)
  WHERE word NOT IN ({_HAN_STOP}) GROUP BY word ORDER BY count DESC, word LIMIT 50)
SELECT f.word, f.count, CASE polarity WHEN 1 THEN 'positive' WHEN -1 THEN 'negative'
                                      ELSE 'neutral' END AS sentiment
FROM frequent f LEFT JOIN lexicon x ON x.word = f.word""",
    "nb_predictions": f"WITH {PREDICTED} SELECT doc_id, prediction FROM predicted",
    "nb_evaluation": f"WITH {EVALUATED} SELECT metric, value FROM evaluation",
    "daily_class_counts": f"WITH {CLASS_DAYS} SELECT date, negative_count, positive_count FROM class_days",
    "trend_history_range": f"""WITH {CLASS_DAYS}
SELECT min(date) AS first_date, max(date) AS last_date,
       CAST(date_diff('day', min(date), max(date)) AS INT) AS last_index FROM class_days""",
    "trend_forecast": _TREND,
    "trend_forecast_row": _TREND_ROW,
    "trend_model_roundtrip": f"""WITH {COMMENTS}, {DAILY},
days AS (SELECT date, date_diff('day', (SELECT min(date) FROM daily), date) AS x, count AS y FROM daily),
{_fit("SELECT x, y FROM days")}
SELECT date, round(mean_y + slope * (x - mean_x), 6) AS fitted_count FROM days, fit""",
    "hourly_interaction_forecast": f"""WITH {COMMENTS}, {_fit(_HOURS)}
SELECT TIMESTAMP '1970-01-01' + to_hours(CAST(x AS INT)) AS hour_start,
       CAST(trunc(predicted) AS BIGINT) AS predicted_interaction FROM {_ahead(24)}""",
}

# --- words found in Chinese texts, and the best path through them ---------------

_IN_HAN = lambda text: f"translate(lower({text}), '{LATIN}', '{HAN}')"
_FOUND = f"""{CORPUS},
runs AS (
  SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_IN_HAN('review')}, '\\p{{Han}}+')) AS run FROM corpus) GROUP BY run),
placed AS (SELECT run, n, unnest(range(1, length(run) + 1)) AS i FROM runs),
grams AS MATERIALIZED (
  SELECT substr(run, i::INT, k::INT) AS gram, sum(n)::BIGINT AS f
  FROM placed, (SELECT unnest(range(1, {han.LONGEST} + 2)) AS k) WHERE i + k - 1 <= length(run) GROUP BY gram),
size AS (SELECT sum(f)::BIGINT AS total FROM grams WHERE length(gram) = 1),
candidates AS (SELECT * FROM grams WHERE f >= {han.LEAST} AND length(gram) BETWEEN 2 AND {han.LONGEST}),
cuts AS (
  SELECT gram, f, left(gram, k::INT) AS head, substr(gram, k::INT + 1) AS tail
  FROM (SELECT gram, f, unnest(range(1, length(gram))) AS k FROM candidates)),
held AS (
  SELECT c.gram, min(ln(c.f) + ln(total) - ln(h.f) - ln(t.f)) AS cohesion
  FROM cuts c JOIN grams h ON h.gram = head JOIN grams t ON t.gram = tail, size GROUP BY c.gram),
""" + ",\n".join(f"""{side}s AS (
  SELECT gram, sum(f) AS seen, sum(f * ln(f)) AS logs FROM (SELECT {known} AS gram, f FROM grams WHERE length(gram) > 1) GROUP BY gram),
{side} AS (
  SELECT g.gram, ln(f) - (coalesce(logs, 0) + CASE WHEN f > coalesce(seen, 0)
    THEN (f - coalesce(seen, 0)) * ln(f - coalesce(seen, 0)) ELSE 0 END) / f AS freedom
  FROM grams g LEFT JOIN {side}s s ON s.gram = g.gram)""" for side, known in (
    ("rightward", "left(gram, length(gram) - 1)"), ("leftward", "substr(gram, 2)"))) + f""",
found AS MATERIALIZED (
  SELECT c.gram AS word, c.f AS count, round(cohesion, 6) AS cohesion, round(l.freedom, 6) AS left_freedom,
         round(r.freedom, 6) AS right_freedom
  FROM candidates c JOIN held h ON h.gram = c.gram JOIN leftward l ON l.gram = c.gram JOIN rightward r ON r.gram = c.gram
  WHERE cohesion >= {han.COHESION} AND l.freedom >= {han.FREEDOM} AND r.freedom >= {han.FREEDOM}
  UNION ALL SELECT gram, f, NULL, NULL, NULL FROM grams WHERE length(gram) = 1)"""

_CUT = f"""{_FOUND},
costs AS (SELECT word, round(1000 * ln(total / count))::BIGINT AS cost FROM found, size),
pieces AS MATERIALIZED (
  SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS place
  FROM (SELECT doc_id, regexp_extract_all({_IN_HAN('text')}, '\\p{{Han}}+|[^\\P{{L}}\\p{{Han}}]+') AS p FROM documents)),
all_runs AS (SELECT DISTINCT piece AS run FROM pieces WHERE regexp_full_match(piece, '\\p{{Han}}+')),
ends AS (SELECT run, unnest(range(1, length(run) + 1)) AS e FROM all_runs),
ways AS MATERIALIZED (
  SELECT run, e, coalesce(w1.cost, round(1000 * ln(2 * total))::BIGINT) AS c1, w2.cost AS c2, w3.cost AS c3, w4.cost AS c4
  FROM ends, size LEFT JOIN costs w1 ON w1.word = substr(run, e::INT, 1)
  LEFT JOIN costs w2 ON e >= 2 AND w2.word = substr(run, e::INT - 1, 2)
  LEFT JOIN costs w3 ON e >= 3 AND w3.word = substr(run, e::INT - 2, 3)
  LEFT JOIN costs w4 ON e >= 4 AND w4.word = substr(run, e::INT - 3, 4)),
path AS (
  SELECT run, 0::BIGINT AS e, 0::BIGINT AS b1, NULL::BIGINT AS b2, NULL::BIGINT AS b3, NULL::BIGINT AS b4, []::INT[] AS backs FROM all_runs
  UNION ALL
  SELECT p.run, w.e, least(b1 + c1, b2 + c2, b3 + c3, b4 + c4), b1, b2, b3,
         list_append(backs, CASE least(b1 + c1, b2 + c2, b3 + c3, b4 + c4) WHEN b1 + c1 THEN 1 WHEN b2 + c2 THEN 2 WHEN b3 + c3 THEN 3 ELSE 4 END)
  FROM path p JOIN ways w ON w.run = p.run AND w.e = p.e + 1),
walk AS (
  SELECT run, e, backs, []::VARCHAR[] AS words FROM path WHERE e = length(run)
  UNION ALL
  SELECT run, e - backs[e], backs, list_prepend(substr(run, (e - backs[e] + 1)::INT, backs[e]::INT), words) FROM walk WHERE e > 0),
cut AS (SELECT run, words FROM walk WHERE e = 0),
docs AS MATERIALIZED (
  SELECT d.doc_id, coalesce(flatten(list(coalesce(c.words, [piece]) ORDER BY place) FILTER (WHERE piece IS NOT NULL)), []) AS words
  FROM documents d LEFT JOIN pieces p ON p.doc_id = d.doc_id LEFT JOIN cut c ON c.run = p.piece GROUP BY d.doc_id)"""

SQL["han_words"] = f"WITH {_FOUND} SELECT * FROM found"
SQL["han_segments"] = f"WITH RECURSIVE {_CUT} SELECT doc_id AS comment_id, array_to_string(words, ' ') AS words FROM docs"
SQL["han_word_sentiment"] = SQL["han_sentiment_labels"].replace(f"WITH {_HAN_LEXICON}", f"WITH RECURSIVE {_HAN_LEXICON.replace(_HAN_DOCS, _CUT)}")

SQL["sentiment_labels_small_bound"] = SQL["sentiment_labels"]
SQL["nb_predictions_small_bound"] = SQL["nb_predictions"]
SQL["corpus_from_csv"] = SQL["lexicon"]
SQL["clean_from_csv"] = f"""SELECT date_trunc('second', created_at) AS created_at,
       content, likes, comments, shares, ip_location, gender FROM ({_CLEAN})"""

SQL["percentiles_by_day"] = f"WITH {COMMENTS} " + " UNION ALL ".join(
    f"""SELECT CAST(created_at AS DATE) AS date, '{c}' AS metric, count({c}) AS n, true AS within
FROM comments GROUP BY 1""" for c in ("likes", "comments", "shares"))
SQL["event_waves"] = f"""WITH RECURSIVE {COMMENTS}, {DAILY},
calendar AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily),
series AS (
  SELECT c.date, coalesce(d.count, 0) AS count, CAST(row_number() OVER (ORDER BY c.date) AS INT) AS i
  FROM calendar c LEFT JOIN daily d ON d.date = c.date),
rates AS (
  SELECT CAST(count(*) AS INT) AS n, avg(count) AS low, CAST(1.03 AS DOUBLE) * avg(count) AS high,
         CAST(round(100 * ln(count(*))) AS BIGINT) AS up FROM series),
priced AS (
  SELECT i, up, CAST(round(1000 * (low - count * ln(low))) AS BIGINT) AS usual_cost,
         CAST(round(1000 * (high - count * ln(high))) AS BIGINT) AS busy_cost FROM series, rates),
ahead AS (
  SELECT 0 AS i, CAST(0 AS BIGINT) AS usual, up AS busy, 0 AS before_usual, 0 AS before_busy FROM rates
  UNION ALL
  SELECT p.i, least(usual, busy) + usual_cost, least(usual + p.up, busy) + busy_cost,
         CASE WHEN busy < usual THEN 1 ELSE 0 END, CASE WHEN usual + p.up < busy THEN 0 ELSE 1 END
  FROM ahead a JOIN priced p ON p.i = a.i + 1),
back AS (
  SELECT i, CASE WHEN busy < usual THEN 1 ELSE 0 END AS state FROM ahead WHERE i = (SELECT n FROM rates)
  UNION ALL
  SELECT b.i - 1, CASE WHEN b.state = 1 THEN before_busy ELSE before_usual END
  FROM back b JOIN ahead a ON a.i = b.i WHERE b.i > 1),
states AS (
  SELECT date, count, state, lag(state, 1, 0) OVER (ORDER BY date) AS previous
  FROM series s JOIN back b ON b.i = s.i),
waves AS (
  SELECT date, count, CASE WHEN state = 1 THEN CAST(sum(CASE WHEN state = 1 AND previous = 0 THEN 1 ELSE 0 END)
                                                    OVER (ORDER BY date) AS INT) END AS wave FROM states),
peaks AS (
  SELECT *, first_value(date) OVER (PARTITION BY wave ORDER BY count DESC, date) AS top FROM waves)
SELECT date, count, wave, CASE WHEN wave IS NULL THEN 'calm' WHEN date < top THEN 'onset'
                               WHEN date = top THEN 'climax' ELSE 'decline' END AS stage FROM peaks"""
SQL["nb_three_classes"] = f"""WITH {DOC_LABELS},
train AS (
  SELECT d.doc_id, d.text, l.sentiment AS label FROM documents d JOIN doc_labels l ON l.doc_id = d.doc_id
  WHERE d.doc_id % 5 <> 0),
sizes AS (SELECT label, count(*) AS n FROM train GROUP BY label),
train_words AS (SELECT doc_id, label, unnest({_words('text')}) AS word FROM train),
idfs AS (
  SELECT word, CASE WHEN count(DISTINCT doc_id) < 5 THEN 0
                    ELSE ln(((SELECT count(*) FROM train) + 1) / (count(DISTINCT doc_id) + 1)) END AS idf
  FROM train_words GROUP BY word),
counts AS (SELECT label, word, count(*) AS tf FROM train_words GROUP BY label, word),
masses AS (
  SELECT s.label, coalesce(sum(tf * idf), 0) + (SELECT count(*) FROM idfs) AS mass
  FROM sizes s LEFT JOIN counts c ON c.label = s.label LEFT JOIN idfs i ON i.word = c.word GROUP BY s.label),
model AS (
  SELECT m.label, i.word, idf * (ln(coalesce(tf, 0) * idf + 1) - ln(mass)) AS weight
  FROM idfs i CROSS JOIN masses m LEFT JOIN counts c ON c.word = i.word AND c.label = m.label WHERE idf > 0),
word_counts AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_words('text')}) AS word FROM documents) GROUP BY 1, 2),
sums AS (SELECT doc_id, label, sum(n * weight) AS total FROM word_counts w JOIN model m ON m.word = w.word GROUP BY 1, 2),
rated AS (
  SELECT d.doc_id, s.label, round(coalesce(total, 0) + ln(n + 1)
         - ln((SELECT sum(n) FROM sizes) + (SELECT count(*) FROM sizes)), 6) AS score
  FROM documents d CROSS JOIN sizes s LEFT JOIN sums t ON t.doc_id = d.doc_id AND t.label = s.label)
SELECT doc_id, first(label ORDER BY score DESC, label) AS prediction FROM rated GROUP BY doc_id"""

# --- bundles: (dataset, query, text columns, number columns) ------------------

_REPORT = (
    ("sentiment_overall_counts", "sentiment_overall", ["sentiment"], ["count"]),
    ("hot_posts_sentiment_counts", "sentiment_hot", ["sentiment"], ["count"]),
    ("interaction_percentiles", "interaction_p99", ["metric"], ["p99"]),
    ("extremely_high_likes_count", "extreme_likes_count", [], ["count"]),
    ("posts_per_hour", "posts_per_hour", [], ["count", "post_hour"]),
    ("posts_per_day", "posts_per_day", ["date"], ["count"]),
    ("event_peak", "event_peak", ["peak_date"], ["peak_count"]),
    ("event_stages", "event_stages", ["date", "stage"], ["count"]),
    ("ip_location_counts", "ip_location_counts", ["ip_location"], ["count"]),
    ("province_post_counts", "province_post_counts", ["name"], ["value"]),
    ("gender_ratio", "gender_ratio", ["gender"], ["count", "share"]),
    ("interaction_per_gender", "interaction_per_gender", ["gender"], ["avg_comments", "avg_likes", "avg_shares"]),
    ("sentiment_per_gender", "sentiment_by_gender", ["gender"], ["negative", "neutral", "positive"]),
    ("sentiment_per_ip_location", "sentiment_by_location", ["ip_location"], ["negative", "neutral", "positive"]),
    ("shares_by_ip_location", "shares_by_location", ["ip_location"], ["total_shares"]),
    ("average_share_conversion_rate", "avg_share_conversion", [], ["average_rate"]),
    ("high_conversion_content_examples", "top_share_conversion", ["content", "sentiment"], ["comment_id", "share_conversion_rate"]),
    ("high_conversion_words", "conversion_top_words", ["word"], ["count"]),
    ("interaction_prediction", "hourly_interaction_forecast", ["hour_start"], ["predicted_interaction"]),
    ("sentiment_over_time", "sentiment_over_time", ["date"], ["negative", "neutral", "positive"]),
    ("frequent_words_sentiment", None, ["sentiment", "word"], ["count"]),
    ("avg_posts_per_gender", "posts_per_user_by_gender", ["gender"], ["avg_posts"]),
    ("top_100_opinion_leaders", "top_opinion_leaders", [], ["total_interaction", "user_id"]),
)


def _long(name: str, query: str, keys, numbers) -> str:
    key = "concat_ws('|', 'k'" + "".join(f", coalesce(CAST({k} AS VARCHAR), '-')" for k in keys) + ")"
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS name, {key} AS key, '{n}' AS "column",
       round(CAST({n} AS DOUBLE), 6) AS number FROM ({query})""" for n in numbers
    )


# The report counts the words of all comments, of which several have one text.
_COMMENT_WORDS = SQL["frequent_words_sentiment"].replace(
    f"WITH {LEXICON}", f"WITH {COMMENTS}, {LEXICON}").replace(
    f"unnest({_words('text')}) AS word FROM documents", f"unnest({_words('content')}) AS word FROM comments")

SQL["results_bundle"] = " UNION ALL ".join(
    _long(name, SQL[query] if query else _COMMENT_WORDS, keys, numbers) for name, query, keys, numbers in _REPORT
)
SQL["learning_bundle"] = " UNION ALL ".join((
    _long("public_opinion_analysis", f"""WITH {CLASS_DAYS}
SELECT strftime(created_at, '%Y-%m-%d') AS date, CAST(prediction AS VARCHAR) AS sentiment_label, count(*) AS "rows",
       sum(length(content)) AS chars
FROM comments c JOIN predicted p ON p.doc_id = c.doc_id GROUP BY 1, 2""", ["date", "sentiment_label"], ["chars", '"rows"']).replace(
        "'\"rows\"'", "'rows'"),
    _long("algorithm_evaluation", f"SELECT 'NaiveBayes Classifier' AS model_type, * FROM ({SQL['nb_evaluation']})",
          ["metric", "model_type"], ["value"]),
    _long("public_opinion_trend_predictions", SQL["trend_forecast"], ["date"], ["predicted_positive_count"]),
))
