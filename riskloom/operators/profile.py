"""Per-account roll-ups of posts/captions and profile derivations.

C01 (mean pairwise caption Jaccard) is quadratic inside an account by
definition.  Items are split into blocks of bounded size per account and each
(account, block i, block j>=i) pair is one cogroup task that returns a single
(sum, count) row, so a hot account spreads over many tasks and no pair rows
are shuffled.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import WS_CLASS

# Caption spam keywords.
CAPTION_SPAM_KEYWORDS = ["follow", "f4f", "l4l", "free", "click", "earn", "dm", "buy",
                         "promo", "giveaway", "win", "lucky", "money", "discount"]
PHONE_PATTERN = r"(?U)\+?\d[\d\s\-]{7,}\d"


def _pair_sums(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    if len(q) == 0 or len(r) == 0:
        return pd.DataFrame({"g": pd.Series([], dtype="int64"), "s": pd.Series([], dtype="float64"),
                             "n": pd.Series([], dtype="int64")})
    same = int(q["bi"].iloc[0]) == int(r["bj"].iloc[0])
    a = [set(t.lower().split()) for t in q["text"]]
    ai = q["item"].to_numpy()
    b = [set(t.lower().split()) for t in r["text"]]
    bi = r["item"].to_numpy()
    s, n = 0.0, 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if same and not ai[i] < bi[j]:
                continue
            inter = len(x & y)
            s += inter / max(len(x | y), 1)
            n += 1
    return pd.DataFrame({"g": [int(q["g"].iloc[0])], "s": [s], "n": [n]})


def caption_similarity(items: DataFrame, group: str, item: str, text: str, block_rows: int = 512) -> DataFrame:
    """Mean Jaccard of lower-cased whitespace word sets over pairs of
    non-blank captions; fewer than 2 captions (blank included) -> 0."""
    counts = items.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("m"))
    nb = F.greatest(F.lit(1), F.ceil(F.col("m") / block_rows)).cast("int")
    x = items.where(F.col(text).isNotNull() & (F.col(text) != "")) \
             .select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(text).alias("text")) \
             .join(counts.select("g", nb.alias("nb")), "g") \
             .withColumn("blk", F.pmod(F.xxhash64("g", "item"), F.col("nb")).cast("int"))
    left = x.select(F.col("g").alias("g"), F.col("item").alias("item"), F.col("text").alias("text"),
                    F.col("blk").alias("bi"), F.explode(F.sequence(F.col("blk"), F.col("nb") - 1)).alias("bj"))
    right = x.select(F.col("g").alias("g"), F.col("item").alias("item"), F.col("text").alias("text"),
                     F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("bi"), F.col("blk").alias("bj"))
    sums = left.groupBy("g", "bi", "bj").cogroup(right.groupBy("g", "bi", "bj")) \
               .applyInPandas(_pair_sums, "g long, s double, n long")
    tot = sums.groupBy("g").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = counts.join(tot, "g", "left")
    sim = F.when((F.col("m") < 2) | F.coalesce(F.col("n") == 0, F.lit(True)), F.lit(0.0)) \
           .otherwise(F.col("s") / F.col("n"))
    return out.select(F.col("g").alias(group), sim.alias("caption_similarity_score"))


def spam_rate(items: DataFrame, group: str, text: str) -> DataFrame:
    """Share of captions containing any caption spam keyword."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = sum((F.instr(low, kw) > 0).cast("int") for kw in CAPTION_SPAM_KEYWORDS) > 0
    return items.groupBy(group).agg(F.avg(hit.cast("double")).alias("spam_comments_rate"))


def age_from_oldest(items: DataFrame, group: str, ts: str, as_of: Column, default: int = 365) -> DataFrame:
    """Whole days from the oldest post to an explicit as-of time, >= 1;
    no parsable timestamp -> default."""
    t = F.col(ts).cast("timestamp") if dict(items.dtypes)[ts] != "string" else F.try_to_timestamp(F.col(ts))
    g = items.groupBy(group).agg(F.min(t).alias("oldest"))
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("oldest")) / 86_400_000_000)
    return g.select(group, F.when(F.col("oldest").isNull(), F.lit(default))
                    .otherwise(F.greatest(F.lit(1), days)).cast("long").alias("account_age_days"))


def engagement(items: DataFrame, group: str, likes: str, comments: str, posts: Column | None = None) -> DataFrame:
    """Total likes / comments and likes per post (posts >= 1)."""
    g = items.groupBy(group).agg(F.sum(F.coalesce(F.col(likes), F.lit(0))).alias("total_likes"),
                                 F.sum(F.coalesce(F.col(comments), F.lit(0))).alias("total_comments"),
                                 F.count(F.lit(1)).alias("n_posts"))
    p = posts if posts is not None else F.col("n_posts")
    return g.withColumn("likes_per_post", F.col("total_likes") / F.greatest(p, F.lit(1)))


def proxies(caption_sim: Column, spam: Column, username: Column, bio: Column, digit_share: float = 0.4):
    """content = .8*caption, generic = .5*spam, randomness = digit share > .4,
    suspicious link = 'http' or 'bit.ly' in lower(bio)."""
    u = F.coalesce(username, F.lit(""))
    digits = F.regexp_count(u, F.lit(r"(?U)\d"))
    low = F.lower(F.coalesce(bio, F.lit("")))
    return {
        "content_similarity_score": caption_sim * 0.8,
        "generic_comment_rate": spam * 0.5,
        "username_randomness": ((digits / F.greatest(F.length(u), F.lit(1))) > digit_share).cast("int"),
        "suspicious_links_in_bio": ((F.instr(low, "http") > 0) | (F.instr(low, "bit.ly") > 0)).cast("int"),
    }


def profile_derivations(df: DataFrame, username="username", full_name="full_name", bio="biography",
                        followers="follower_count", following="following_count", url="external_url") -> DataFrame:
    """The 13 derived profile columns."""
    u = F.coalesce(F.col(username), F.lit(""))
    fn = F.coalesce(F.col(full_name), F.lit(""))
    b = F.coalesce(F.col(bio), F.lit(""))
    digits = F.regexp_count(u, F.lit(r"(?U)\d"))
    words = F.filter(F.split(fn, WS_CLASS + "+"), lambda w: w != "")
    return df.select(
        "*",
        F.length(u).cast("long").alias("username_length"), F.length(fn).cast("long").alias("fullname_length"),
        F.length(b).cast("long").alias("bio_length"),
        (F.coalesce(F.col(url), F.lit("")) != "").alias("has_external_url"),
        (F.col(followers) / F.greatest(F.col(following), F.lit(1))).alias("follower_following_ratio"),
        u.rlike(r"(?U)\d").alias("username_has_numbers"),
        u.rlike(r"[^\p{L}\p{N}._]").alias("username_has_special_chars"),
        F.size(words).cast("long").alias("fullname_word_count"),
        b.rlike(r"(?i)http[s]?://|www\.").alias("bio_has_url"),
        b.rlike(PHONE_PATTERN).alias("bio_has_phone"),
        b.rlike(r"[^\x{00}-\x{7F}]").alias("bio_has_emoji"),
        digits.cast("long").alias("digits_in_username"),
        (digits / F.greatest(F.length(u), F.lit(1))).alias("username_digit_ratio"))
