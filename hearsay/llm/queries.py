"""The registered queries of the operators over ``documents``, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import fingerprints, language, line_dedup, lm_scoring, mixing, near_dedup, packing, phrases, pii, quality, repeats, spelling, toxicity
from hearsay.llm.tables import documents, labels, remainder


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", remainder("doc_id", 7) == 2)
    return lm_scoring.score(docs)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cleaned(documents(spark, sf_dir, "doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir, "doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    known = labels(spark, sf_dir).filter(remainder("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.fit(docs, known))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_matches", "terms")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir, "doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir, "doc_id", "text"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.fit(docs.filter(remainder("doc_id", 3) != 1))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    cleaned = line_dedup.clean(docs, line_dedup.build(docs))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir, "text", "lang"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_repeats": op2_repeats,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_near_dedup": op6_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_line_dedup": op11_line_dedup,
    "op12_phrases": op12_phrases,
    "op13_spelling": op13_spelling,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MIXING_SQL = rf"""WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [{', '.join(f'{w:.1f}::DOUBLE' for w in mixing.WEIGHTS)}][
           CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS INT) + 1] AS weight,
         source_size * {float(mixing.MOST_COPIES)}::DOUBLE AS cap,
         sum(source_size) OVER () * {mixing.SHARE}::DOUBLE AS pool FROM sums),
levels AS (
  SELECT *, (pool - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
line AS (
  SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, doc_id) AS place,
         ('0x' || substr(md5('0|' || coalesce(s.source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS first
  FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source),
copied AS (
  SELECT *, CAST(least(floor(first + place * rate) - floor(first + (place - 1) * rate), {mixing.MOST_COPIES}) AS BIGINT) AS copies
  FROM line)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM copied"""

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


def _limits(rules) -> str:
    parts = []
    for r in rules:
        if r.least is not None:
            parts.append(f"100 * {r.measure} >= {r.least} * {r.base}")
        if r.most is not None:
            parts.append(f"100 * {r.measure} <= {r.most} * {r.base}")
    return " AND ".join(parts)


_QUALITY_SQL = rf"""WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM places),
covered AS (
  SELECT doc_id, CAST(count(DISTINCT place) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE n > 1) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(words, lambda w: w IN ({_STOP}))) AS BIGINT) AS n_stop_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, 1 AS one
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id),
judged AS (SELECT *, NOT ({_limits(quality.BASE_RULES)}) AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_limits(quality.RULES)} AS kept FROM judged"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES_SQL = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_DOCUMENTS}),
marked AS (SELECT k.*, f.key IS NOT NULL AS drops FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE drops) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT drops), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_PHRASES_SQL = rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
sizes AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
counts AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, w[i:i + m - 1] AS words, count(*)::HUGEINT AS f
  FROM places, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {phrases.LEAST_COUNT}),
cuts AS (
  SELECT lang, phrase, words, m, f, unnest(range(1, m)) AS k FROM counts WHERE m > 1),
scores AS (
  SELECT c.lang, c.phrase, c.words, c.m, c.f, k, a.f AS l, b.f AS r, (1000000 * c.f * c.f) // (a.f * b.f) AS score
  FROM cuts c JOIN counts a ON a.lang = c.lang AND a.phrase = array_to_string(c.words[1:k], ' ')
  JOIN counts b ON b.lang = c.lang AND b.phrase = array_to_string(c.words[k + 1:c.m], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(words[1:2], ' ') AS phrase, f FROM counts WHERE m = 3 UNION ALL
    SELECT lang, array_to_string(words[2:3], ' ') AS phrase, f FROM counts WHERE m = 3) GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase AND b.m = 2
  WHERE o.f IS NULL OR 100 * o.f < {phrases.INSIDE_PERCENT} * b.f)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase,
       f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept k JOIN sizes s ON s.lang = k.lang QUALIFY rank <= {phrases.TOP}"""

# CRC-32 byte by byte, with its table of 256 entries; letters beyond ASCII have two bytes.
_SPELLING_SQL = rf"""WITH RECURSIVE bits AS (
  SELECT b, b::BIGINT AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS steps FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
    ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h
  FROM counted, crc),
kept AS (
  SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN concat(left(run, (h % length(run))::INT), substr(run, (h % length(run))::INT + 2))
         ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word
  HAVING sum(n) >= {spelling.LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
shorter AS (SELECT word, n, i, concat(left(word, i::INT - 1), substr(word, i::INT + 1)) AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION
  SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON b.word = a.rest UNION
  SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON b.word = a.rest),
best AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
linked AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 2 * w.n THEN other END AS form,
         CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
ways AS (
  SELECT word, word AS root, 0 AS k FROM linked UNION ALL
  SELECT w.word, l.form, k + 1 FROM ways w JOIN linked l ON l.word = w.root WHERE l.form IS NOT NULL),
roots AS (SELECT word, root FROM ways QUALIFY row_number() OVER (PARTITION BY word ORDER BY k DESC) = 1)
SELECT l.word, form, root, n, n_near, form_n FROM linked l JOIN roots r ON r.word = l.word"""

SQL = {
    "op3_mixing": _MIXING_SQL,
    "op9_quality": _QUALITY_SQL,
    "op11_line_dedup": _LINES_SQL,
    "op12_phrases": _PHRASES_SQL,
    "op13_spelling": _SPELLING_SQL,
}
