"""Class counts, SMOTE, stratified split and folds,
seeded sampling and the generator's row normalisation.

Random choices come from md5 of (seed, key, ...) so they are reproducible on
any partitioning and in both engines (trap T13).  Per-class ranks are
distributed prefix counts, not a window over the two labels (two tasks).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import dense_rank_in_group


def hash_key(seed: int, *cols) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                                     for c in cols]))


def hash_unit(seed: int, *cols) -> Column:
    """Uniform [0,1) from the first 13 hex digits of md5(seed-cols)."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """B01"""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _class_sizes(df: DataFrame, label: str) -> Column:
    return class_distribution(df, label).agg(F.map_from_entries(F.collect_list(F.struct(label, "n")))).scalar()


def stratified_split(df: DataFrame, key: str, label: str = "label", test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Per class, rows ordered by md5(seed-key); the first ceil(test_size*n)
    go to 'test'.  Exact counts; the rank is a distributed prefix count."""
    h = df.withColumn("_h", hash_key(seed, key))
    r = dense_rank_in_group(h, label, ["_h", key], name="_r")
    sizes = _class_sizes(df, label)
    return r.withColumn("split", F.when(F.col("_r") <= F.ceil(F.lit(test_size) * sizes[F.col(label)]), "test")
                        .otherwise("train")).drop("_h", "_r")


def stratified_folds(df: DataFrame, key: str, label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """fold = (rank-1) mod k inside each class in md5 order."""
    h = df.withColumn("_h", hash_key(seed, key))
    r = dense_rank_in_group(h, label, ["_h", key], name="_r")
    return r.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_h", "_r")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows in md5(seed-key) order (top-n, no global sort); when the pool is
    smaller than n, rows are repeated (with replacement), copies ordered the same way."""
    pool = df.count()
    if pool == 0:
        return df
    reps = max(1, math.ceil(n / pool))
    x = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))) if reps > 1 \
        else df.withColumn("_copy", F.lit(0))
    return x.orderBy(hash_key(seed, key, "_copy"), F.col(key), "_copy").limit(n).drop("_copy")


def normalise_genuine(df: DataFrame) -> DataFrame:
    """Caps for genuine rows (followers <= 21000, following in 1..2281,
    posts >= 1), ratio and posts/day (6 decimals)."""
    fol = F.least(F.coalesce(F.col("followers").cast("double"), F.lit(0.0)), F.lit(21000.0))
    fing = F.least(F.greatest(F.coalesce(F.col("following").cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(2281.0))
    posts = F.greatest(F.coalesce(F.col("posts").cast("double"), F.lit(0.0)), F.lit(1.0))
    age = F.col("account_age_days").cast("double")
    return df.select("*", F.floor(fol).alias("_f"), F.floor(fing).alias("_g"), F.floor(posts).alias("_p"),
                     F.round(fol / F.greatest(fing, F.lit(1.0)), 6).alias("_r"),
                     F.round(posts / age, 6).alias("_ppd")) \
             .drop("followers", "following", "posts") \
             .withColumnRenamed("_f", "followers").withColumnRenamed("_g", "following") \
             .withColumnRenamed("_p", "posts").withColumnRenamed("_r", "follower_following_ratio") \
             .withColumn("posts_per_day", F.col("_ppd")).drop("_ppd")


# Generator defaults for fake rows ("x or default").
FAKE_DEFAULTS = {"account_age_days": 365, "caption_similarity_score": 0.7, "content_similarity_score": 0.7,
                 "follow_unfollow_rate": 200, "spam_comments_rate": 100, "generic_comment_rate": 80}


def normalise_fake(df: DataFrame) -> DataFrame:
    """Falsy defaults (P20) and the recomputed ratio for fake rows."""
    out = df
    for c, d in FAKE_DEFAULTS.items():
        if c in df.columns:
            x = F.col(c).cast("double")
            out = out.withColumn(c, F.when(x.isNull() | (x == 0), F.lit(float(d))).otherwise(x))
    fol = F.coalesce(F.col("followers").cast("double"), F.lit(0.0))
    fing = F.coalesce(F.col("following").cast("double"), F.lit(0.0))
    return out.withColumn("follower_following_ratio", F.round(fol / F.greatest(fing, F.lit(1.0)), 6))


def union_shuffled(parts: list[DataFrame], key: str, seed: int = 42) -> DataFrame:
    """Vertical union (columns by name, gaps filled) in md5 order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("_h", hash_key(seed, key)).orderBy("_h").drop("_h")


def smote(df: DataFrame, key: str, vec: str, label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """B03 (+B06 guard): interpolate minority rows toward one of their k minority
    neighbours until both classes have the same size.  Copies per seed row come
    from its md5 rank (exact total), neighbour and lambda from md5(seed, key, copy).
    Returns the input plus synthetic rows (key = NULL, synthetic = true)."""
    from .neighbors import knn_exact
    counts = {r[label]: r["n"] for r in class_distribution(df, label).collect()}   # two rows
    if len(counts) < 2:
        return df.withColumn("synthetic", F.lit(False))
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], max(counts.values())
    if n_min <= k or n_min == n_maj:
        return df.withColumn("synthetic", F.lit(False))
    need = n_maj - n_min
    mino = df.where(F.col(label) == minority)
    base, extra = divmod(need, n_min)
    r = dense_rank_in_group(mino.withColumn("_g", F.lit(0)).withColumn("_h", hash_key(seed, key)),
                            "_g", ["_h", key], name="_r")
    copies = r.withColumn("_n", F.lit(base) + F.when(F.col("_r") <= extra, 1).otherwise(0)) \
              .where(F.col("_n") > 0) \
              .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    nn = knn_exact(mino, mino, k, key, key, vec, exclude_self=True)
    pick = copies.withColumn("_rank", (F.pmod(F.conv(F.substring(hash_key(seed + 1, key, "_copy"), 1, 8), 16, 10)
                                              .cast("long"), F.lit(k)) + 1).cast("int")) \
                 .withColumn("_lam", hash_unit(seed + 2, key, "_copy"))
    nbr = nn.select(F.col("qid").alias("_q"), F.col("rank").alias("_rank2"), F.col("rid").alias("_nid"))
    vecs = mino.select(F.col(key).cast("long").alias("_nid"), F.col(vec).alias("_nv"))
    syn = pick.join(nbr, (F.col(key).cast("long") == F.col("_q")) & (F.col("_rank") == F.col("_rank2"))) \
              .join(vecs, "_nid") \
              .select(F.lit(None).cast(df.schema[key].dataType).alias(key),
                      F.zip_with(F.col(vec), F.col("_nv"), lambda a, b: (a + F.col("_lam") * (b - a)).cast("float"))
                      .alias(vec),
                      F.lit(minority).alias(label), F.lit(True).alias("synthetic"),
                      F.col(key).alias("seed_key"), F.col("_nid").alias("neighbour_key"), F.col("_lam").alias("lam"))
    orig = df.select(key, vec, label).withColumn("synthetic", F.lit(False))
    return orig.unionByName(syn, allowMissingColumns=True)


def attach_modes(balanced: DataFrame, original: DataFrame, cols: list[str]) -> DataFrame:
    """B05 (option): re-attach string columns as the column's mode (one constant per
    column, as the reference does); the flow keeps the seed row's strings instead."""
    from .clean import modes
    m = {r["column_name"]: r["mode"] for r in modes(original, cols).collect()}   # one row per column
    return balanced.select(*[c for c in balanced.columns if c not in cols],
                           *[F.lit(m.get(c, "")).alias(c) for c in cols])
