"""Hand-made literals (FIXTURES section 4) with hand-computed expectations."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from riskloom.functions.columns import entropy, py_fixed
from riskloom.operators import clean as C
from riskloom.operators import output as O
from riskloom.operators.features import metadata_features
from riskloom.operators.fusion import threshold_grid
from riskloom.operators.profile import caption_similarity
from riskloom.streaming import monitor as MON


def test_username_features(spark):
    rows = [(1, ""), (2, "aabbbc"), (3, "b0t_43$@17")]
    df = spark.createDataFrame(rows, "account_id long, username string")
    f = {r.account_id: r for r in metadata_features(df).collect()}
    assert f[1].username_length == 0 and f[1].username_entropy == 0.0
    assert f[2].repeat_char_count == 3.0
    h = -(2 / 6 * math.log2(2 / 6) + 3 / 6 * math.log2(3 / 6) + 1 / 6 * math.log2(1 / 6))
    assert abs(f[2].username_entropy - h) < 1e-12
    assert f[3].digits_count == 5.0 and f[3].special_char_count == 3.0
    assert abs(f[3].digit_ratio - 0.5) < 1e-12


def test_adversarial_normalisation(spark):
    df = spark.createDataFrame([("b0t_43$@17", "hi​there﻿"), ("ｂｏｔ", "x­y")],
                               "username string, bio string")
    out = C.adversarial_normalise(df).collect()
    assert out[0].username == "bot_aesait" and out[0].bio == "hithere"
    assert out[1].username == "bot" and out[1].bio == "xy"
    assert out[0].username_raw == "b0t_43$@17"


def test_entropy_nan_rule(spark):
    df = spark.createDataFrame([("nan",), ("",), ("ab",)], "u string")
    r = df.select(entropy(F.col("u"), nan_is_empty=True).alias("h")).collect()
    assert [x.h for x in r] == [0.0, 0.0, 1.0]


def test_numeric_coercion_and_zero_denominators(spark):
    df = spark.createDataFrame([("12", "0", None), ("abc", "4", "0")], "followers string, following string, posts string")
    f = metadata_features(df, keep=()).collect()
    assert f[0].followers == 12.0 and f[0].follower_following_ratio == 0.0
    assert f[1].followers == 0.0 and f[1].follower_following_ratio == 0.0
    assert f[0].account_age_days == 365.0 and f[0].account_hour == 0.0


def test_genuineness_bonus_edges(spark):
    rows = [(50.0, 100.0, 0.0, 0, 0, ""), (100.0, 20.0, 5.0, 0, 0, ""), (101.0, 20.0, 5.0, 0, 0, ""),
            (500.0, 100.0, 5.0, 1, 0, "x"), (501.0, 100.0, 5.0, 1, 1, "x"), (60.0, 200.0, 0.0, 0, 0, "")]
    df = spark.createDataFrame(rows, "followers double, following double, posts double, has_pic int, verified int, "
                                     "bio string")
    b = df.select(O.genuineness_bonus(F.col("followers"), F.col("following"), F.col("posts"),
                                      F.col("has_pic").cast("boolean"), F.col("verified").cast("boolean"),
                                      F.col("bio")).alias("b")).collect()
    got = [round(x.b, 4) for x in b]
    # ratio .5 -> +.04; 5.0 -> +.04; 5.05 / 5.01 -> none; >100 +.03; >500 +.02; pic +.02; verified +.08;
    # lurker (no posts, > 50 followers) +.05; 0 < len(bio) < 200 +.01
    assert got == [0.04, 0.04, 0.03, 0.10, 0.16, 0.09]


def test_risk_band_edges(spark):
    df = spark.createDataFrame([(0.2999,), (0.30,), (0.32,), (0.60,), (0.85,)], "p double")
    bands = [r.b for r in df.select(O.risk_band(F.col("p")).alias("b")).collect()]
    assert bands == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL"]


def test_caption_similarity_cases(spark):
    rows = [(1, 0, "Hello world"),                         # one caption -> 0
            (2, 0, "free stuff"), (2, 1, "free stuff"),   # equal -> 1
            (3, 0, "a b"), (3, 1, "c d"),                 # disjoint -> 0
            (4, 0, ""), (4, 1, "x y"),                    # blank dropped -> no pair -> 0
            (5, 0, "a b c"), (5, 1, "a b"), (5, 2, "c")]  # (2/3 + 1/3 + 0) / 3
    df = spark.createDataFrame(rows, "g long, item long, text string")
    got = {r.g: r.caption_similarity_score for r in caption_similarity(df, "g", "item", "text").collect()}
    assert got[1] == 0.0 and got[2] == 1.0 and got[3] == 0.0 and got[4] == 0.0
    assert abs(got[5] - (2 / 3 + 1 / 3 + 0) / 3) < 1e-12


def test_caption_similarity_blocked_equals_single_block(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e", "f"]
    rows = [(g, i, " ".join(rng.sample(words, rng.randint(1, 4)))) for g in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, "g long, item long, text string")
    one = {r.g: r.caption_similarity_score for r in caption_similarity(df, "g", "item", "text").collect()}
    many = {r.g: r.caption_similarity_score for r in caption_similarity(df, "g", "item", "text", block_rows=4).collect()}
    for g in one:
        assert abs(one[g] - many[g]) < 1e-12


def test_latest_alert_wins_and_low_dropped(spark):
    rows = [("2024-01-01 08:00:00", "u1", 0.9, "CRITICAL", "s1"), ("2024-01-01 20:00:00", "u1", 0.95, "CRITICAL", "s2"),
            ("2024-01-01 09:00:00", "u2", 0.1, "LOW", "s1")]
    df = spark.createDataFrame(rows, "t string, username string, probability double, risk_band string, scan_id string") \
        .withColumn("scan_ts", F.to_timestamp("t")).drop("t")
    la = MON.latest_alerts(MON.route_alerts(df)).collect()
    assert len(la) == 1 and la[0].scan_id == "s2"


def test_python_style_formatting(spark):
    random.seed(7)
    vals = [61.25, 62.65, 2.675, 0.125, 0.05, 99.95, 0.0, 100.0] + [random.random() * 100 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (0, 1, 2):
        got = [r.s for r in df.select(py_fixed(F.col("x"), d).alias("s")).collect()]
        assert got == [f"{v:.{d}f}" for v in vals]


def test_threshold_grid_matches_numpy():
    g = threshold_grid()
    assert len(g) == 62 and g == list(np.arange(0.20, 0.81, 0.01))
