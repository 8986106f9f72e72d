"""The metadata feature projection.

One narrow `select` (no shuffle); Catalyst shares the repeated sub-expressions.
Absent input columns resolve to constants at plan time, so the output schema is
always the same 34 DOUBLE columns (plus the pass-through key columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, contains_flag, digit_count, entropy, num, repeat_char_count, text

# Fixed values that must equal the reference: the 13 bio spam keywords, in order.
SPAM_KEYWORDS = [
    "follow back", "followback", "f4f", "l4l", "free", "click", "buy now",
    "discount", "promo", "earn money", "work from home", "dm me", "link in bio",
]

URL_PATTERN = r"https?://|www\."

FEATURE_NAMES = [
    "has_profile_pic", "verified", "bio_length", "bio_has_url", "bio_spam_score",
    "followers", "following", "follow_diff", "follower_following_ratio", "followers_ratio",
    "posts", "account_age_days", "posts_per_day", "activity_rate", "log_followers",
    "log_posts", "account_hour", "account_weekend", "listed_ratio", "likes_per_post",
    "caption_similarity_score", "content_similarity_score", "follow_unfollow_rate",
    "spam_comments_rate", "generic_comment_rate", "suspicious_links_in_bio",
    "verified_low_follow", "username_length", "username_randomness", "digits_count",
    "digit_ratio", "special_char_count", "repeat_char_count", "username_entropy",
]


def spam_score(bio_lower):
    return sum((F.instr(bio_lower, kw) > 0).cast("int") for kw in SPAM_KEYWORDS)


def metadata_features(df: DataFrame, keep=("account_id",), prefix: str = "") -> DataFrame:
    """F01-F34 as one projection; `keep` passes columns through, `prefix` renames outputs."""
    bio = text("bio") if "bio" in df.columns else F.lit("")
    uname = text("username") if "username" in df.columns else F.lit("")
    followers, following, posts = num(df, "followers"), num(df, "following"), num(df, "posts")
    age_raw = num(df, "account_age_days", 365.0)
    age = F.when(age_raw == 0, F.lit(365.0)).otherwise(age_raw)
    age0 = num(df, "account_age_days", 0.0)
    verified = clip(num(df, "verified"), 0.0, 1.0)
    ulen = F.length(uname).cast("double")
    digits = digit_count(uname).cast("double")

    feats = {
        "has_profile_pic": clip(num(df, "has_profile_pic"), 0.0, 1.0),
        "verified": verified,
        "bio_length": num(df, "bio_length") if "bio_length" in df.columns else F.length(bio),
        "bio_has_url": contains_flag(bio, URL_PATTERN),
        "bio_spam_score": spam_score(F.lower(bio)),
        "followers": followers,
        "following": following,
        "follow_diff": followers - following,
        "follower_following_ratio": F.when(following > 0, followers / F.greatest(following, F.lit(1.0)))
                                     .otherwise(F.lit(0.0)),
        "followers_ratio": followers / (followers + following + 1),
        "posts": posts,
        "account_age_days": age,
        "posts_per_day": posts / F.greatest(age, F.lit(1.0)),
        "activity_rate": F.least(posts / (followers + 1), F.lit(100.0)),
        "log_followers": F.log1p(followers),
        "log_posts": F.log1p(posts),
        "account_hour": F.pmod(age0, F.lit(24.0)),
        "account_weekend": (F.pmod(age0, F.lit(7.0)) >= 5).cast("int"),
        "listed_ratio": num(df, "listed_count") / (followers + 1),
        "likes_per_post": num(df, "favourites_count") / (posts + 1),
        "caption_similarity_score": num(df, "caption_similarity_score"),
        "content_similarity_score": num(df, "content_similarity_score"),
        "follow_unfollow_rate": num(df, "follow_unfollow_rate"),
        "spam_comments_rate": num(df, "spam_comments_rate"),
        "generic_comment_rate": num(df, "generic_comment_rate"),
        "suspicious_links_in_bio": clip(num(df, "suspicious_links_in_bio"), 0.0, 1.0),
        "verified_low_follow": ((verified == 0) & (followers < 100)).cast("int"),
        "username_length": ulen,
        "username_randomness": num(df, "username_randomness"),
        "digits_count": digits,
        "digit_ratio": digits / F.greatest(ulen, F.lit(1.0)),
        "special_char_count": F.regexp_count(uname, F.lit("[^a-zA-Z0-9]")),
        "repeat_char_count": repeat_char_count(uname),
        "username_entropy": num(df, "username_entropy") if "username_entropy" in df.columns
        else entropy(uname),
    }
    cols = [F.col(k) for k in keep if k in df.columns]
    cols += [F.coalesce(c.cast("double"), F.lit(0.0)).alias(prefix + n) for n, c in feats.items()]
    return df.select(*cols)
