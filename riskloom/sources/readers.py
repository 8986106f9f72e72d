"""File sources and sinks with the reference's harmonisation.

Every CSV is read with an all-STRING schema and coerced with try_cast, which is
pandas' to_numeric(errors='coerce').  A loader that fails (missing path,
unreadable file) is skipped by `load_datasets`; failure is detected at plan
time (schema resolution), not by counting rows.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import class_to_label, presence_length, strip_ws, url_flag, yes_no_flag
from ..operators.ordering import running_totals

log = logging.getLogger(__name__)

# The numeric columns of the labelled account files, and the
# 20-column order of the evaluation CSV.
PRIMARY_NUMERIC = ["has_profile_pic", "bio_length", "username_randomness", "followers", "following",
                   "follower_following_ratio", "account_age_days", "posts", "posts_per_day",
                   "caption_similarity_score", "content_similarity_score", "follow_unfollow_rate",
                   "spam_comments_rate", "generic_comment_rate", "suspicious_links_in_bio", "verified"]
EVAL_COLUMNS = ["platform"] + PRIMARY_NUMERIC + ["is_fake", "username", "bio"]
FOLLOWER_DUMP_COLUMNS = ["screen_name", "description", "followers_count", "friends_count", "statuses_count",
                         "verified", "default_profile_image"]
MULTICLASS_COLUMNS = ["Followers", "Following", "Following/Followers", "Posts", "Posts/Followers", "Bio",
                      "Profile Picture", "External Link", "Labels"]


def read_csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; every column STRING (explicit schema when known, no inference)."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        r = r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return r.csv(path)


def num(c: str) -> Column:
    return strip_ws(F.col(c)).try_cast("double")


def row_index(df: DataFrame) -> DataFrame:
    """S07 without a natural key: consecutive 0-based index in scan order
    (monotonic id + distributed prefix count; never an unpartitioned row_number)."""
    x = df.withColumn("_mono", F.monotonically_increasing_id()).withColumn("_one", F.lit(1))
    return running_totals(x, ["_mono"], ["_one"]).withColumnRenamed("cum__one", "_idx").drop("_mono", "_one")


def surrogate(prefix: str, df: DataFrame, key: str | None) -> tuple[DataFrame, Column]:
    """`prefix_<key>` from the natural key, else from the scan-order index."""
    if key and key in df.columns:
        return df, F.concat(F.lit(prefix), F.col(key).cast("string"))
    df = row_index(df)
    return df, F.concat(F.lit(prefix), F.col("_idx").cast("string"))


def load_labelled(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """is_fake -> label (int), 16 numeric columns coerced, bio '', synthetic
    username, _source 'primary' (S06)."""
    raw = read_csv_strings(spark, path)
    raw, uname = surrogate("unknown_", raw, key)
    cols = [F.col(c) for c in raw.columns if c not in PRIMARY_NUMERIC + ["is_fake", "username", "bio", "_idx"]]
    return raw.select(*cols, *[num(c).alias(c) for c in PRIMARY_NUMERIC if c in raw.columns],
                      num("is_fake").cast("int").alias("label"), F.lit("").alias("bio"), uname.alias("username"),
                      F.lit("primary").alias("_source"))


def load_follower_dump(spark: SparkSession, path: str) -> DataFrame:
    """All rows fake; counts coerced (missing -> 0), picture = 1 - clip(default image),
    eight behavioural columns missing, link flag from the description."""
    raw = read_csv_strings(spark, path, FOLLOWER_DUMP_COLUMNS)
    z = lambda c: F.coalesce(num(c), F.lit(0.0))
    bio = F.coalesce(F.col("description"), F.lit(""))
    nulls = ["account_age_days", "posts_per_day", "username_randomness", "caption_similarity_score",
             "content_similarity_score", "follow_unfollow_rate", "spam_comments_rate", "generic_comment_rate"]
    return raw.select(
        F.coalesce(F.col("screen_name"), F.lit("")).alias("username"), bio.alias("bio"),
        z("followers_count").alias("followers"), z("friends_count").alias("following"),
        z("statuses_count").alias("posts"), z("verified").alias("verified"),
        (1 - F.least(F.greatest(F.coalesce(num("default_profile_image"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))
        .alias("has_profile_pic"),
        F.when(z("friends_count") > 0, z("followers_count") / z("friends_count")).otherwise(F.lit(0.0))
        .alias("follower_following_ratio"),
        *[F.lit(None).cast("double").alias(c) for c in nulls],
        F.length(bio).cast("double").alias("bio_length"),
        url_flag(bio).alias("suspicious_links_in_bio"),
        F.lit(1).alias("label"), F.lit("twitter_fake").alias("_source"))


def load_multiclass(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """yes/no flags (P02), presence length 80 (P04), class label (P03); the
    Following/Followers column is kept under its own name (trap T18)."""
    raw = read_csv_strings(spark, path)
    raw, uname = surrogate("limfadd_", raw, key)
    z = lambda c: F.coalesce(num(c), F.lit(0.0)) if c in raw.columns else F.lit(0.0)
    col = lambda c, d: F.col(c) if c in raw.columns else F.lit(d)
    nulls = ["account_age_days", "username_randomness", "caption_similarity_score", "content_similarity_score",
             "follow_unfollow_rate", "spam_comments_rate", "generic_comment_rate", "posts_per_day"]
    keep = [F.col(key)] if key and key in raw.columns else []
    return raw.select(
        *keep, z("Followers").alias("followers"), z("Following").alias("following"),
        z("Following/Followers").alias("following_per_follower"),
        z("Posts").alias("posts"), z("Posts/Followers").alias("posts_per_follower"),
        presence_length(col("Bio", "N")).alias("bio_length"), F.lit("").alias("bio"),
        yes_no_flag(col("Profile Picture", "N")).alias("has_profile_pic"),
        yes_no_flag(col("External Link", "N")).alias("suspicious_links_in_bio"),
        uname.alias("username"), F.lit(0).alias("verified"),
        *[F.lit(None).cast("double").alias(c) for c in nulls],
        class_to_label(col("Labels", "Real")).alias("label"), F.lit("limfadd").alias("_source"))


def load_spreadsheet_export(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Like S01; label from is_fake, else label, else 1; unparsable -> 1;
    bio/username only added when absent (plan-time column check)."""
    raw = read_csv_strings(spark, path)
    if "is_fake" in raw.columns:
        lab = num("is_fake")
    elif "label" in raw.columns:
        lab = num("label")
    else:
        lab = F.lit(1.0)
    out = raw
    if "username" not in raw.columns:
        out, uname = surrogate("excel_", raw, key)
        out = out.withColumn("username", uname)
    if "bio" not in out.columns:
        out = out.withColumn("bio", F.lit(""))
    keep = [c for c in out.columns if c not in PRIMARY_NUMERIC + ["is_fake", "label", "_idx"]]
    return out.select(*keep, *[num(c).alias(c) for c in PRIMARY_NUMERIC if c in out.columns],
                      F.coalesce(lab, F.lit(1.0)).cast("int").alias("label"), F.lit("excel_global").alias("_source"))


def load_datasets(spark: SparkSession, sources: list[tuple]) -> DataFrame:
    """Try every (loader, path); skip missing/broken ones with a warning;
    fail if none; vertical union with column fill (open schema)."""
    frames = []
    for loader, path in sources:
        try:
            df = loader(spark, path)
            df.schema  # noqa: B018  (forces analysis: bad path/schema fails here)
            frames.append(df)
        except (AnalysisException, FileNotFoundError, OSError) as ex:
            log.warning("skipping %s: %s", path, str(ex)[:200])
    if not frames:
        raise RuntimeError("No datasets could be loaded.")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_eval_csv(df: DataFrame, path: str, extra=()) -> None:
    """CSV sink with the fixed 20-column order (missing columns empty);
    `extra` columns are appended after them."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in EVAL_COLUMNS]
    cols += [F.col(c) for c in extra]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def load_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation CSV; the truth column is optional and kept as is_fake."""
    raw = read_csv_strings(spark, path)
    truth = [num("is_fake").cast("int").alias("is_fake")] if "is_fake" in raw.columns else []
    return raw.select(*[c for c in raw.columns if c not in PRIMARY_NUMERIC + ["is_fake"]],
                      *[num(c).alias(c) for c in PRIMARY_NUMERIC if c in raw.columns], *truth)
