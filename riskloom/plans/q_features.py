"""Queries: the accounts mapping (S12 roll-up) and F01-F34."""

from pyspark.sql import functions as F

from ..operators.features import FEATURE_NAMES, metadata_features
from .common import acc, round_doubles, with_accounts
from .registry import query
from .sql_features import FEATURES_SQL

_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in FEATURE_NAMES)


@query("s12_account_rollup", with_accounts(
    "SELECT account_id, username, bio, bio_length, followers, following, posts, account_age_days, verified, "
    "has_profile_pic, follow_unfollow_rate, spam_comments_rate, generic_comment_rate, "
    "round(caption_similarity_score, 6) AS caption_similarity_score, label FROM accounts"))
def s12_account_rollup(spark, sf_dir):
    return round_doubles(acc(spark, sf_dir))


@query("f01_metadata_features", with_accounts(f"SELECT account_id, {_ROUNDED} FROM features", FEATURES_SQL))
def f01_metadata_features(spark, sf_dir):
    return round_doubles(metadata_features(acc(spark, sf_dir)))
