"""DuckDB form of the F01-F34 projection over the `accounts` CTE (oracle side)."""

from ..operators.features import FEATURE_NAMES, SPAM_KEYWORDS

_SPAM = " + ".join(f"CAST(contains(lower(bio_t), '{kw}') AS INTEGER)" for kw in SPAM_KEYWORDS)

_ENTROPY = ("CASE WHEN length(u) = 0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split(u, '')), "
            "lambda ch: ((length(u) - length(replace(u, ch, ''))) / length(u)) * "
            "log2((length(u) - length(replace(u, ch, ''))) / length(u)))) END")

_REPEAT = ("CASE WHEN length(u) < 2 THEN 0 ELSE list_sum(list_transform(range(1, length(u)), "
           "lambda i: CAST(substr(u, i, 1) = substr(u, i + 1, 1) AS INTEGER))) END")

FEATURE_SQL_EXPR = {
    "has_profile_pic": "least(greatest(coalesce(CAST(has_profile_pic AS DOUBLE), 0), 0), 1)",
    "verified": "ver",
    "bio_length": "coalesce(bio_length, 0)",
    "bio_has_url": r"CAST(regexp_matches(bio_t, 'https?://|www\.') AS INTEGER)",
    "bio_spam_score": _SPAM,
    "followers": "fo",
    "following": "fi",
    "follow_diff": "fo - fi",
    "follower_following_ratio": "CASE WHEN fi > 0 THEN fo / greatest(fi, 1) ELSE 0 END",
    "followers_ratio": "fo / (fo + fi + 1)",
    "posts": "po",
    "account_age_days": "age",
    "posts_per_day": "po / greatest(age, 1)",
    "activity_rate": "least(po / (fo + 1), 100)",
    "log_followers": "ln(1 + fo)",
    "log_posts": "ln(1 + po)",
    "account_hour": "((age0 % 24) + 24) % 24",
    "account_weekend": "CAST(((age0 % 7) + 7) % 7 >= 5 AS INTEGER)",
    "listed_ratio": "0 / (fo + 1)",
    "likes_per_post": "0 / (po + 1)",
    "caption_similarity_score": "coalesce(caption_similarity_score, 0)",
    "content_similarity_score": "0",
    "follow_unfollow_rate": "coalesce(follow_unfollow_rate, 0)",
    "spam_comments_rate": "coalesce(spam_comments_rate, 0)",
    "generic_comment_rate": "coalesce(generic_comment_rate, 0)",
    "suspicious_links_in_bio": "0",
    "verified_low_follow": "CAST(ver = 0 AND fo < 100 AS INTEGER)",
    "username_length": "length(u)",
    "username_randomness": "0",
    "digits_count": "length(u) - length(regexp_replace(u, '[0-9]', '', 'g'))",
    "digit_ratio": "(length(u) - length(regexp_replace(u, '[0-9]', '', 'g'))) / greatest(length(u), 1)",
    "special_char_count": "length(regexp_replace(u, '[a-zA-Z0-9]', '', 'g'))",
    "repeat_char_count": _REPEAT,
    "username_entropy": _ENTROPY,
}
assert list(FEATURE_SQL_EXPR) == FEATURE_NAMES

# CTE `features` (unrounded) over `accounts`
FEATURES_SQL = """
prep AS (
  SELECT *, coalesce(bio, '') AS bio_t, coalesce(username, '') AS u,
         coalesce(followers, 0) AS fo, coalesce(following, 0) AS fi, coalesce(posts, 0) AS po,
         CASE WHEN coalesce(account_age_days, 365) = 0 THEN 365 ELSE coalesce(account_age_days, 365) END AS age,
         coalesce(account_age_days, 0) AS age0,
         least(greatest(coalesce(CAST(verified AS DOUBLE), 0), 0), 1) AS ver
  FROM accounts),
features AS (
  SELECT account_id, label, username, """ + ",\n         ".join(
    f"CAST(coalesce({e}, 0) AS DOUBLE) AS {n}" for n, e in FEATURE_SQL_EXPR.items()) + """
  FROM prep)"""
