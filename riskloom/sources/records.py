"""API profile documents and their media as 26-column account rows.

A profile and its media are JSON texts.  The media list of an account is bounded
(the newest MEDIA_LIMIT), so everything about it is computed inside the row:
nothing is shuffled but the items that newest_media() rolls up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import digit_count, repeat_char_count
from ..operators.clean import WS_CLASS
from ..operators.profile import CAPTION_SPAM_KEYWORDS

MEDIA_LIMIT = 20
PROFILE = ("username string, biography string, profile_picture_url string, followers_count long, follows_count long, "
           "media_count long, is_verified boolean")
MEDIUM = "caption string, like_count long, comments_count long, timestamp string"

# The account row's columns in the reference's order, its default age and weights.
RECORD_COLUMNS = ["username", "bio", "has_profile_pic", "bio_length", "username_randomness", "followers", "following",
                  "follower_following_ratio", "account_age_days", "posts", "posts_per_day", "caption_similarity_score",
                  "content_similarity_score", "follow_unfollow_rate", "spam_comments_rate", "generic_comment_rate",
                  "suspicious_links_in_bio", "verified", "username_length", "digits_count", "digit_ratio",
                  "special_char_count", "repeat_char_count", "likes_per_post", "listed_count", "favourites_count"]
DEFAULT_AGE_DAYS = 365
CONTENT_SHARE, GENERIC_SHARE, RANDOM_DIGITS = 0.8, 0.5, 0.4


def newest_media(items: DataFrame, key: str, order: list[Column], limit: int = MEDIA_LIMIT) -> DataFrame:
    """(key, media): the first `limit` items of each account in the given order
    (newest first) as a JSON array.  The limit is taken in the map tasks already,
    so an account with a third of all items sends `limit` rows from each."""
    fields = [f.split()[0] for f in MEDIUM.split(", ")]
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= limit)
    listed = F.sort_array(F.collect_list(F.struct("_rank", F.struct(*fields).alias("m"))))
    return ranked.groupBy(key).agg(listed.alias("l")).select(key, F.to_json(F.transform("l", lambda x: x["m"])).alias("media"))


def _similarity(captions: Column) -> Column:
    """Mean Jaccard of the word sets of all pairs of non-blank captions; 0 with fewer than two captions."""
    words = F.transform(F.filter(captions, lambda c: c != ""), lambda c: F.array_distinct(
        F.filter(F.split(F.lower(c), WS_CLASS + "+"), lambda w: w != "")))
    n = F.size(words)
    total = F.aggregate(words, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")), lambda acc, a: F.struct(
        (acc["s"] + F.aggregate(F.slice(words, acc["i"] + 2, F.lit(MEDIA_LIMIT)), F.lit(0.0), lambda s, b: (
            s + F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))))).alias("s"),
        (acc["i"] + 1).alias("i")))["s"]
    return F.when((F.size(captions) < 2) | (n < 2), F.lit(0.0)).otherwise(total / (n * (n - 1) / 2))


def _age(stamps: Column, as_of: Column) -> Column:
    """Whole days since the oldest time stamp, at least 1; the default without one or if one cannot be read."""
    read = F.transform(stamps, lambda t: F.regexp_replace(t, r"([+-]\d\d)(\d\d)$", "$1:$2").try_cast("timestamp"))
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(F.array_min(read))) / F.lit(86_400_000_000))
    known = (F.size(stamps) > 0) & ~F.exists(read, lambda t: t.isNull())
    return F.when(known, F.greatest(days, F.lit(1))).otherwise(F.lit(DEFAULT_AGE_DAYS)).cast("long")


def account_record(df: DataFrame, profile: str, media: str, as_of: Column, keep: list[str] = ()) -> DataFrame:
    """Columns `keep` and RECORD_COLUMNS of every row, from the JSON texts
    `profile` and `media` (array, the newest MEDIA_LIMIT items first).

    Defined results: a null or unreadable profile or list reads as empty; null
    counts are 0; a null caption is blank; items beyond the limit are left out;
    an empty table gives an empty result.
    """
    p = F.coalesce(F.from_json(profile, PROFILE), F.from_json(F.lit("{}"), PROFILE))
    m = F.coalesce(F.from_json(media, f"array<struct<{', '.join(f.replace(' ', ':') for f in MEDIUM.split(', ')) }>>"), F.array())
    x = df.select(*[F.col(c) for c in keep], p.alias("p"), F.slice(m, 1, MEDIA_LIMIT).alias("m"), as_of.alias("as_of"))
    x = x.select(*keep, "p", "as_of", F.coalesce("p.username", F.lit("")).alias("u"), F.coalesce("p.biography", F.lit("")).alias("bio"),
                 *[F.coalesce(f"p.{a}", F.lit(0)).alias(b) for a, b in (
                     ("followers_count", "followers"), ("follows_count", "following"), ("media_count", "posts"))],
                 F.transform("m", lambda i: F.coalesce(i["caption"], F.lit(""))).alias("captions"),
                 F.aggregate("m", F.lit(0).cast("long"), lambda s, i: s + F.coalesce(i["like_count"], F.lit(0))).alias("likes"),
                 F.filter(F.transform("m", lambda i: i["timestamp"]), lambda t: t.isNotNull() & (t != "")).alias("stamps"))
    one = F.lit(1)
    spam = F.aggregate("captions", F.lit(0), lambda s, c: s + F.when(
        F.exists(F.array(*[F.lit(w) for w in CAPTION_SPAM_KEYWORDS]), lambda w: F.contains(F.lower(c), w)), 1).otherwise(0))
    x = x.select("*", _similarity(F.col("captions")).alias("sim"), _age(F.col("stamps"), F.col("as_of")).alias("age"),
                 F.when(F.size("captions") > 0, spam / F.size("captions")).otherwise(F.lit(0.0)).alias("spam"),
                 digit_count(F.col("u")).alias("digits"), F.length("u").alias("chars"))
    flag = lambda c: c.cast("int")
    out = {
        "username": F.col("u"), "bio": F.col("bio"), "has_profile_pic": flag(F.coalesce("p.profile_picture_url", F.lit("")) != ""),
        "bio_length": F.length("bio"), "username_randomness": flag(F.col("digits") / F.greatest("chars", one) > RANDOM_DIGITS),
        "followers": F.col("followers"), "following": F.col("following"),
        "follower_following_ratio": F.col("followers") / F.greatest("following", one), "account_age_days": F.col("age"),
        "posts": F.col("posts"), "posts_per_day": F.col("posts") / F.greatest("age", one),
        "caption_similarity_score": F.col("sim"), "content_similarity_score": F.col("sim") * CONTENT_SHARE,
        "follow_unfollow_rate": F.lit(0), "spam_comments_rate": F.col("spam"), "generic_comment_rate": F.col("spam") * GENERIC_SHARE,
        "suspicious_links_in_bio": flag(F.lower("bio").contains("http") | F.lower("bio").contains("bit.ly")),
        "verified": flag(F.coalesce("p.is_verified", F.lit(False))), "username_length": F.col("chars"), "digits_count": F.col("digits"),
        "digit_ratio": F.col("digits") / F.greatest("chars", one),
        "special_char_count": F.regexp_count("u", F.lit(r"[^\p{L}\p{N}]")), "repeat_char_count": repeat_char_count(F.col("u")),
        "likes_per_post": F.col("likes") / F.greatest("posts", one), "listed_count": F.lit(0), "favourites_count": F.col("likes")}
    return x.select(*keep, *[out[c].alias(c) for c in RECORD_COLUMNS])
