"""Profile documents (nested JSON), fallbacks, prediction rows,
manual form rows, username lists and demo-row normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import WS_CLASS, strip_ws
from ..operators.output import estimate_age

_COUNT = T.StructType([T.StructField("count", T.LongType())])
WEB_PAYLOAD_SCHEMA = T.StructType([T.StructField("data", T.StructType([T.StructField("user", T.StructType([
    T.StructField("username", T.StringType()), T.StructField("full_name", T.StringType()),
    T.StructField("biography", T.StringType()), T.StructField("profile_pic_url", T.StringType()),
    T.StructField("external_url", T.StringType()), T.StructField("category_name", T.StringType()),
    T.StructField("is_private", T.BooleanType()), T.StructField("is_verified", T.BooleanType()),
    T.StructField("edge_followed_by", _COUNT), T.StructField("edge_follow", _COUNT),
    T.StructField("edge_owner_to_timeline_media", _COUNT)]))]))])

# Fields always available from a profile page; business_category only when public.
AVAILABLE_FIELDS = ["username", "full_name", "biography", "follower_count", "following_count", "post_count",
                    "is_verified", "has_profile_pic", "external_url"]
# Training genuine medians used for unobservable behaviour.
PREDICTION_DEFAULTS = {"caption_similarity_score": 0.29, "content_similarity_score": 0.23,
                       "follow_unfollow_rate": 68, "spam_comments_rate": 15, "generic_comment_rate": 58}

PROFILE_COLUMNS = ["username", "full_name", "biography", "follower_count", "following_count", "post_count",
                   "is_private", "is_verified", "has_profile_pic", "profile_pic_url", "external_url",
                   "business_category", "is_partial", "available_fields"]


def _available(is_private: Column) -> Column:
    base = [F.lit(x) for x in AVAILABLE_FIELDS]
    return F.when(is_private, F.array(*base)).otherwise(F.array(*base, F.lit("business_category")))


def flatten_web_payload(df: DataFrame, json_col: str, default_username: Column | None = None) -> DataFrame:
    """Parse the nested payload with a fixed schema and flatten it; a payload
    without data.user yields no row."""
    u = F.from_json(F.col(json_col), WEB_PAYLOAD_SCHEMA)["data"]["user"]
    x = df.select("*", u.alias("_u")).where(F.col("_u").isNotNull())
    priv = F.coalesce(F.col("_u.is_private"), F.lit(False))
    uname = F.coalesce(F.col("_u.username"), default_username if default_username is not None else F.lit(None))
    return x.select(
        *[c for c in df.columns if c != json_col],
        uname.alias("username"),
        F.coalesce(F.col("_u.full_name"), F.lit("")).alias("full_name"),
        F.coalesce(F.col("_u.biography"), F.lit("")).alias("biography"),
        F.coalesce(F.col("_u.edge_followed_by.count"), F.lit(0)).alias("follower_count"),
        F.coalesce(F.col("_u.edge_follow.count"), F.lit(0)).alias("following_count"),
        F.coalesce(F.col("_u.edge_owner_to_timeline_media.count"), F.lit(0)).alias("post_count"),
        priv.alias("is_private"), F.coalesce(F.col("_u.is_verified"), F.lit(False)).alias("is_verified"),
        (F.coalesce(F.col("_u.profile_pic_url"), F.lit("")) != "").alias("has_profile_pic"),
        F.coalesce(F.col("_u.profile_pic_url"), F.lit("")).alias("profile_pic_url"),
        F.coalesce(F.col("_u.external_url"), F.lit("")).alias("external_url"),
        F.coalesce(F.col("_u.category_name"), F.lit("")).alias("business_category"),
        priv.alias("is_partial"), _available(priv).alias("available_fields"))


def loader_record(df: DataFrame) -> DataFrame:
    """Second-source record to the same schema; category blank when private."""
    priv = F.coalesce(F.col("is_private").cast("boolean"), F.lit(False))
    pic = F.coalesce(F.col("profile_pic_url"), F.lit(""))
    return df.select(
        F.col("username"), F.coalesce(F.col("full_name"), F.lit("")).alias("full_name"),
        F.coalesce(F.col("biography"), F.lit("")).alias("biography"),
        F.col("followers").cast("long").alias("follower_count"),
        F.col("followees").cast("long").alias("following_count"),
        F.col("mediacount").cast("long").alias("post_count"),
        priv.alias("is_private"), F.coalesce(F.col("is_verified").cast("boolean"), F.lit(False)).alias("is_verified"),
        (pic != "").alias("has_profile_pic"), pic.alias("profile_pic_url"),
        F.coalesce(F.col("external_url"), F.lit("")).alias("external_url"),
        F.when(priv, F.lit("")).otherwise(F.coalesce(F.col("business_category_name"), F.lit("")))
        .alias("business_category"),
        priv.alias("is_partial"), _available(priv).alias("available_fields"))


def private_warning(df: DataFrame) -> Column:
    """S13 (web): warning text for partial (private) rows."""
    return F.when(F.col("is_partial"), F.concat(F.lit("Private profile — prediction uses partial data: "),
                                                F.array_join("available_fields", ", ")))


def two_source_fallback(primary: DataFrame, secondary: DataFrame, key: str = "username") -> DataFrame:
    """Primary record when present, else the secondary one, else no row."""
    return primary.unionByName(secondary.join(primary.select(key), key, "left_anti"))


def prediction_row(profile: DataFrame, keep=("account_id",)) -> DataFrame:
    """Profile -> pipeline row: genuine-median defaults for 5 unobservable
    features, age estimate (R05), category '' -> 'unknown'."""
    posts, fol, fing = F.col("post_count"), F.col("follower_count"), F.col("following_count")
    age = estimate_age(posts, fol, fing)
    return profile.select(
        *[k for k in keep if k in profile.columns], "username", F.col("full_name").alias("fullname"), F.col("biography").alias("bio"), "biography",
        fol.alias("followers"), fing.alias("following"), posts.alias("posts"),
        F.col("is_private").cast("int").alias("is_private"), F.col("is_verified").cast("int").alias("is_verified"),
        F.col("is_verified").cast("int").alias("verified"), F.col("has_profile_pic").cast("int").alias("has_profile_pic"),
        (F.col("external_url") != "").cast("int").alias("has_external_url"),
        F.coalesce(F.col("biography"), F.lit("")).rlike(r"(?i)http[s]?://|www\.").cast("int")
        .alias("suspicious_links_in_bio"),
        age.alias("account_age_days"), (posts / F.greatest(age, F.lit(1))).alias("posts_per_day"),
        F.lit(0).alias("username_randomness"),
        *[F.lit(v).alias(k) for k, v in PREDICTION_DEFAULTS.items()],
        F.when(F.col("business_category") == "", F.lit("unknown")).otherwise(F.col("business_category"))
        .alias("business_category"))


def manual_form_row(form: DataFrame, keep=("account_id",)) -> DataFrame:
    """A form row (username, biography, website, followers, following, posts,
    has_profile_pic, verified) -> pipeline row with the same defaults."""
    bio = F.coalesce(F.col("biography"), F.lit(""))
    low = F.lower(bio)
    fol, fing, posts = (F.col(c).cast("long") for c in ("followers", "following", "posts"))
    link = ((F.coalesce(F.col("website"), F.lit("")) != "") | (F.instr(low, "http") > 0) | (F.instr(low, "bit.ly") > 0))
    age = estimate_age(posts, fol, fing)
    return form.select(
        *[k for k in keep if k in form.columns],
        F.coalesce(F.col("username"), F.lit("manual_input")).alias("username"), bio.alias("bio"),
        F.coalesce(F.col("has_profile_pic").cast("boolean"), F.lit(False)).cast("int").alias("has_profile_pic"),
        F.length(bio).alias("bio_length"), F.lit(0).alias("username_randomness"),
        fol.alias("followers"), fing.alias("following"),
        (fol / F.greatest(fing, F.lit(1))).alias("follower_following_ratio"),
        age.alias("account_age_days"), posts.alias("posts"), (posts / F.greatest(age, F.lit(1))).alias("posts_per_day"),
        *[F.lit(v).alias(k) for k, v in PREDICTION_DEFAULTS.items()],
        link.cast("int").alias("suspicious_links_in_bio"),
        F.coalesce(F.col("verified").cast("boolean"), F.lit(False)).cast("int").alias("verified"))


def username_list(text: Column, web: bool = True) -> Column:
    """Comma list -> names: split, strip; the web path also removes leading
    '@' and drops blanks, the command-line path only strips."""
    parts = F.transform(F.split(text, ","), lambda x: strip_ws(x))
    if not web:
        return parts
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^@+", "")), lambda x: x != "")


def demo_rows(df: DataFrame) -> DataFrame:
    """Demo profile -> account row (deterministic part): genuine rows are
    clamped (followers <= 21000, following 100..2281, posts >= 660), picture
    flag from the digit share (> .45), link flag, randomness flag (> .35).
    The behavioural columns are inputs here (the reference fabricates them)."""
    u = F.coalesce(F.col("username"), F.lit(""))
    share = F.regexp_count(u, F.lit(r"(?U)\d")) / F.greatest(F.length(u), F.lit(1))
    bio = F.coalesce(F.col("biography"), F.lit(""))
    low = F.lower(bio)
    genuine = F.coalesce(F.col("is_fake"), F.lit(0)) == 0
    fol = F.when(genuine, F.least(F.col("followers_count"), F.lit(21000))).otherwise(F.col("followers_count"))
    fing = F.when(genuine, F.greatest(F.least(F.col("follows_count"), F.lit(2281)), F.lit(100))) \
            .otherwise(F.col("follows_count"))
    posts = F.when(genuine, F.greatest(F.col("media_count"), F.lit(660))).otherwise(F.col("media_count"))
    return df.select(
        "*", F.when((F.length(u) == 0) | (share > 0.45), F.lit(0)).otherwise(F.lit(1)).alias("has_profile_pic"),
        F.length(bio).alias("bio_length"), (share > 0.35).cast("int").alias("username_randomness"),
        fol.alias("followers"), fing.alias("following"),
        F.round(fol / F.greatest(fing, F.lit(1)), 6).alias("follower_following_ratio"), posts.alias("posts"),
        ((F.instr(low, "http") > 0) | (F.instr(low, "bit.ly") > 0)).cast("int").alias("suspicious_links_in_bio"),
        F.coalesce(F.col("is_verified").cast("boolean"), F.lit(False)).cast("int").alias("verified"))


WS = WS_CLASS
