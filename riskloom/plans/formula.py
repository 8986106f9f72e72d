"""A deterministic scored table for the fusion, metric, output and explanation
oracles: three closed-form 'model' probabilities over the metadata features
of `accounts`, fused by the reference's weighted vote and threshold sweep.
(The learned models are in operators/models.py; their scores are checked by
invariants, these closed forms by DuckDB.)"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators.features import FEATURE_NAMES, metadata_features
from ..operators.fusion import (fitted_weights, optimal_threshold, soft_vote, threshold_grid, threshold_predict,
                                vote_weights)
from ..operators.vectors import standardize
from ..session import cut_lineage
from .common import acc
from .sql_features import FEATURES_SQL

PROB_COLS = ["p_events", "p_network", "p_profile"]
RAW_COLS = ["bio_length", "has_profile_pic", "verified", "posts", "followers", "following"]


def scored(spark, sf_dir):
    a = acc(spark, sf_dir)
    f = metadata_features(a, keep=a.columns, prefix="f_")
    return f.select(
        "*",
        F.least(F.greatest(F.col("f_caption_similarity_score") / 5, F.lit(0.0)), F.lit(1.0)).alias("p_events"),
        (1 - F.col("f_followers_ratio")).alias("p_network"),
        (1 / (1 + F.exp(-(2 * F.col("f_verified_low_follow") + (1 - F.col("f_has_profile_pic"))
                          + 0.5 * F.col("f_posts_per_day") - 1.5)))).alias("p_profile"))


def weights(spark, sf_dir):
    return vote_weights(scored(spark, sf_dir).where(F.col("label").isNotNull()), PROB_COLS)


def fused(spark, sf_dir):
    """Fit (weights, threshold) on label and probabilities of the labelled rows,
    the only columns materialised, then score every row lazily with the fitted
    constants; the reader's columns decide what is computed."""
    s = scored(spark, sf_dir)
    lab = cut_lineage(s.select("label", *PROB_COLS).where(F.col("label").isNotNull()))
    w = fitted_weights(vote_weights(lab, PROB_COLS))
    thr = optimal_threshold(soft_vote(lab, PROB_COLS, w, "probability"), "probability").first()["threshold"]
    return threshold_predict(soft_vote(s, PROB_COLS, w, "probability"), "probability", thr)


def explained(spark, sf_dir):
    """fused + magnitude attributions over standardised features, ranked."""
    s = cut_lineage(fused(spark, sf_dir).drop("bio"))           # read twice: statistics, then rows
    fcols = [f"f_{n}" for n in FEATURE_NAMES]
    z = standardize(s, fcols, prefix="z", keep=s.columns)
    attr = X.magnitude_attributions(FEATURE_NAMES, [F.col(f"zf_{n}") for n in FEATURE_NAMES])
    return z.withColumn("attributions", attr) \
            .withColumn("top_attributions", F.slice(X.rank_estimated(F.col("attributions"), 10), 1, 5))


# ---------------------------------------------------------------- DuckDB side

def _f1(tp, fp, fn):
    return f"CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END"


_WROWS = "\n UNION ALL\n ".join(
    f"SELECT '{m}' AS model, " + _f1(f"count(*) FILTER (WHERE {m} > 0.5 AND label = 1)",
                                      f"count(*) FILTER (WHERE {m} > 0.5 AND label = 0)",
                                      f"count(*) FILTER (WHERE {m} <= 0.5 AND label = 1)")
    + " AS f1 FROM sc WHERE label IS NOT NULL" for m in PROB_COLS)
_GRID_DELTA = "((CAST(0.2 AS DOUBLE) + CAST(0.01 AS DOUBLE)) - CAST(0.2 AS DOUBLE))"
assert abs(threshold_grid()[12] - 0.3200000000000001) < 1e-18

SCORED_SQL = FEATURES_SQL + """,
sc AS (
  SELECT *,
         least(greatest(caption_similarity_score / 5, 0.0), 1.0) AS p_events,
         1 - followers_ratio AS p_network,
         1 / (1 + exp(-(2 * verified_low_follow + (1 - has_profile_pic) + 0.5 * posts_per_day - 1.5))) AS p_profile
  FROM features),
wraw AS (""" + _WROWS + """),
wts AS (SELECT model, f1, CASE WHEN sum(f1) OVER () > 0 THEN f1 / sum(f1) OVER () ELSE 1.0 / 3 END AS weight FROM wraw),
wv AS (SELECT max(weight) FILTER (WHERE model = 'p_events') AS we, max(weight) FILTER (WHERE model = 'p_network') AS wn,
              max(weight) FILTER (WHERE model = 'p_profile') AS wp FROM wts),
fv AS (SELECT sc.*, (0 + p_events * we + p_network * wn + p_profile * wp) / (0 + we + wn + wp) AS probability
       FROM sc, wv),
grid AS (SELECT CAST(0.2 AS DOUBLE) + i * """ + _GRID_DELTA + """ AS t FROM range(62) r(i)),
sweep AS (SELECT t AS threshold, """ + _f1("count(*) FILTER (WHERE probability >= t AND label = 1)",
                                         "count(*) FILTER (WHERE probability >= t AND label = 0)",
                                         "count(*) FILTER (WHERE probability < t AND label = 1)") + """ AS f1
          FROM grid, fv WHERE fv.label IS NOT NULL GROUP BY t),
best AS (SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1),
fused AS (SELECT fv.*, CAST(probability >= (SELECT threshold FROM best) AS INTEGER) AS pred FROM fv)"""

ESTIMATED_SQL = "(" + ", ".join(f"'{n}'" for n in X.ESTIMATED_FEATURES) + ")"
_STATS = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in FEATURE_NAMES)
_LONG = "\n UNION ALL\n ".join(
    f"SELECT account_id, {i} AS idx, '{n}' AS name, "
    f"(CASE WHEN s_{n} = 0 OR s_{n} IS NULL THEN 0.0 ELSE ({n} - m_{n}) / s_{n} END) * 0.01 AS value FROM fused, st"
    for i, n in enumerate(FEATURE_NAMES))

ATTR_SQL = SCORED_SQL + f""",
st AS (SELECT {_STATS} FROM fused),
attr AS ({_LONG}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY
             abs(value) * CASE WHEN name IN {ESTIMATED_SQL} THEN {X.ESTIMATED_WEIGHT} ELSE 1.0 END DESC, idx) AS rank
           FROM attr),
top5 AS (SELECT * FROM ranked WHERE rank <= 5)"""


def _map_case(col, d, default):
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in d.items())
    return f"CASE {whens} ELSE {default} END"


_ZD = _map_case("t.name", X.FEATURE_DESCRIPTIONS_ZERO, "NULL")
_D = _map_case("t.name", X.FEATURE_DESCRIPTIONS, "t.name")
_ZF = ("CASE " + " ".join(f"WHEN t.name = '{k}' THEN {str(v).upper()}" for k, v in X.FEATURE_ZERO_IS_FAKE_SIGNAL.items())
       + " ELSE NULL END")
_RAW = ("CASE " + " ".join(f"WHEN t.name = '{c}' THEN CAST(a.{c} AS DOUBLE)" for c in RAW_COLS) + " ELSE NULL END")

ANNOT_SQL = ATTR_SQL + f""",
z0 AS (SELECT t.*, coalesce(({_RAW}) = 0, FALSE) AND ({_ZD}) IS NOT NULL AS is_zero, {_ZD} AS zdesc, {_D} AS desc0,
              {_ZF} AS zfake, f.label AS label_i, f.probability, f.pred
       FROM top5 t JOIN accounts a ON a.account_id = t.account_id JOIN fused f ON f.account_id = t.account_id),
ann AS (SELECT account_id, rank, name, value, probability, pred,
               CASE WHEN is_zero THEN zdesc ELSE desc0 END AS description,
               CASE WHEN is_zero AND zfake IS NOT NULL THEN CASE WHEN zfake THEN 'increases_fake' ELSE 'decreases_fake' END
                    WHEN value > 0 THEN 'increases_fake' ELSE 'decreases_fake' END AS direction,
               abs(value) / CASE WHEN sum(abs(value)) OVER (PARTITION BY account_id) = 0 THEN 1.0
                                 ELSE sum(abs(value)) OVER (PARTITION BY account_id) END * 100 AS pct,
               name IN {ESTIMATED_SQL} AS estimated
        FROM z0)"""
