"""Column names and types of the raw, stored and analysis tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw column -> stored column ------------------------------
STORED_NAMES = {
    "create_date_time": "创建日期时间",
    "content": "内容",
    "comments_count": "评论数",
    "liked_count": "点赞数",
    "shared_count": "分享数",
    "ip_location": "IP属地",
    "gender": "性别",
}

# --- fixed values: stored column -> analysis column -------------------------
ANALYSIS_NAMES = {
    "内容": "content",
    "创建日期时间": "created_at",
    "点赞数": "likes",
    "评论数": "comments",
    "分享数": "shares",
    "IP属地": "ip_location",
    "性别": "gender",
}

# --- fixed values: columns dropped from the raw tables ----------------------
IDENTIFIERS = (
    "comment_id", "create_time", "note_id", "last_modify_ts", "parent_comment_id",
    "user_id", "nickname", "profile_url", "avatar",
)
TOP_LEVEL_IDENTIFIERS = (*IDENTIFIERS, "source_keyword", "note_url")

# --- fixed values: reply-table column -> top-level-table column -------------
REPLY_NAMES = {"comment_like_count": "liked_count", "sub_comment_count": "comments_count"}

# Raw timestamps carry an offset.
TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm:ssXXX"

# Ids the engine keeps (when present) although they are not analysis columns:
# comment_id identifies a comment, user_id is needed for per-user questions.
KEPT_IDS = ("comment_id", "user_id")

RAW_COLUMNS = tuple(STORED_NAMES)
COUNT_COLUMNS = ("likes", "comments", "shares")
SENTIMENTS = ("positive", "negative", "neutral")


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# Raw CSV columns are read as text: a count such as "1.2万" must reach the
# tolerant cast instead of failing (or re-typing) the scan.
TOP_LEVEL_SCHEMA = _strings(*TOP_LEVEL_IDENTIFIERS, *RAW_COLUMNS)
REPLY_SCHEMA = _strings(
    *IDENTIFIERS, "create_date_time", "content", "sub_comment_count", "comment_like_count",
    "ip_location", "gender",
)
CORPUS_SCHEMA = T.StructType(
    [T.StructField("review", T.StringType()), T.StructField("label", T.IntegerType())]
)
