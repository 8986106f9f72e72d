"""Queries: fusion (M15-M18), metrics (M21-M27), output (O01-O05),
recalibration (R01-R05) and explanation (X02-X12) over the formula scores."""

from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import metrics as M
from ..operators import output as O
from ..operators.features import FEATURE_NAMES
from ..operators.fusion import optimal_threshold, soft_vote
from .common import round_doubles, with_accounts
from .formula import ANNOT_SQL, ATTR_SQL, PROB_COLS, SCORED_SQL, explained, fused, scored, weights
from .registry import query


def _q(body, base=SCORED_SQL):
    return with_accounts(body, base)


def _lab(spark, sf_dir):
    return fused(spark, sf_dir).where(F.col("label").isNotNull()).withColumn("score", F.col("probability"))


@query("m15_vote_weights", _q("SELECT model, round(f1, 6) AS f1, round(weight, 6) AS weight FROM wts"))
def m15_vote_weights(spark, sf_dir):
    return round_doubles(weights(spark, sf_dir))


@query("m16_soft_vote", _q("SELECT account_id, round(probability, 6) AS soft_vote FROM fv"))
def m16_soft_vote(spark, sf_dir):
    s = scored(spark, sf_dir)
    return round_doubles(soft_vote(s, PROB_COLS, weights(spark, sf_dir)).select("account_id", "soft_vote"))


@query("m16_soft_vote_equal", _q("SELECT account_id, round((0 + p_events + p_network + p_profile) / 3, 6) AS soft_vote FROM sc"))
def m16_soft_vote_equal(spark, sf_dir):
    return round_doubles(soft_vote(scored(spark, sf_dir), PROB_COLS).select("account_id", "soft_vote"))


@query("m17_threshold", _q("SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best"))
def m17_threshold(spark, sf_dir):
    s = fused(spark, sf_dir).where(F.col("label").isNotNull())
    return round_doubles(optimal_threshold(s, "probability"))


@query("m18_predict", _q("SELECT account_id, pred FROM fused"))
def m18_predict(spark, sf_dir):
    return fused(spark, sf_dir).select("account_id", "pred")


@query("m21_accuracy", _q("SELECT round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy FROM fused WHERE label IS NOT NULL"))
def m21_accuracy(spark, sf_dir):
    return round_doubles(M.accuracy(_lab(spark, sf_dir)))


@query("m22_roc_auc", _q("""SELECT round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM (
  SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM (SELECT probability AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
        FROM fused WHERE label IS NOT NULL GROUP BY probability))"""))
def m22_roc_auc(spark, sf_dir):
    return round_doubles(M.roc_auc(_lab(spark, sf_dir)))


_CNT = ("count(*) FILTER (WHERE pred = 1 AND label = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND label = 0) AS fp, "
        "count(*) FILTER (WHERE pred = 0 AND label = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND label = 0) AS tn")


def _f1(a, b, c):
    return f"CASE WHEN 2 * {a} + {b} + {c} > 0 THEN 2 * {a} / (2 * {a} + {b} + {c}) ELSE 0.0 END"


@query("m23_f1_scores", _q(f"SELECT round({_f1('tp', 'fp', 'fn')}, 6) AS f1_fake, round({_f1('tn', 'fn', 'fp')}, 6) "
                           f"AS f1_genuine FROM (SELECT {_CNT} FROM fused WHERE label IS NOT NULL)"))
def m23_f1_scores(spark, sf_dir):
    return round_doubles(M.f1_scores(_lab(spark, sf_dir)))


@query("m24_confusion", _q(f"""SELECT label, pred, n FROM (SELECT {_CNT} FROM fused WHERE label IS NOT NULL),
  LATERAL (VALUES (0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)) v(label, pred, n)"""))
def m24_confusion(spark, sf_dir):
    return M.confusion(_lab(spark, sf_dir))


_CR = f"""c AS (SELECT {_CNT} FROM fused WHERE label IS NOT NULL),
per AS (SELECT 'genuine' AS class_name, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS precision,
               CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS recall, {_f1('tn', 'fn', 'fp')} AS f1,
               tn + fp AS support FROM c
        UNION ALL
        SELECT 'fake', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, {_f1('tp', 'fp', 'fn')}, tp + fn FROM c)"""


@query("m25_classification_report", with_accounts(
    """SELECT class_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
              CAST(support AS BIGINT) AS support FROM per
       UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
              CAST(sum(support) AS BIGINT) FROM per
       UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
              round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
              CAST(sum(support) AS BIGINT) FROM per""", SCORED_SQL, _CR))
def m25_classification_report(spark, sf_dir):
    return round_doubles(M.classification_report(_lab(spark, sf_dir)))


@query("m26_truth_summary", _q(f"""SELECT total, correct,
    CASE WHEN total > 0 THEN round_even(correct / total * 100, 1) ELSE 0.0 END AS accuracy, precision, recall,
    round_even(2 * precision * recall / greatest(precision + recall, 0.001), 1) AS f1
  FROM (SELECT total, tp + tn AS correct,
               round_even(tp / greatest(tp + fp, 1) * 100, 1) AS precision,
               round_even(tp / greatest(tp + fn, 1) * 100, 1) AS recall
        FROM (SELECT count(*) AS total, {_CNT} FROM fused WHERE label IS NOT NULL))"""))
def m26_truth_summary(spark, sf_dir):
    return M.truth_summary(_lab(spark, sf_dir))


def _even(x, n):
    """Half-even rounding to n decimals: ties go to the even neighbour, the rest as round()."""
    s = f"(({x}) * 1e{n})"
    return f"CASE WHEN {s} - floor({s}) = 0.5 AND floor({s}) % 2 = 0 THEN floor({s}) / 1e{n} ELSE round({x}, {n}) END"


@query("m27_evaluate", with_accounts(f"""SELECT {_even('acc', 4)} AS accuracy, {_even('auc', 4)} AS roc_auc,
    {_even(_f1('tp', 'fp', 'fn'), 4)} AS f1_fake, {_even(_f1('tn', 'fn', 'fp'), 4)} AS f1_genuine
  FROM (SELECT avg(CAST(label = pred AS DOUBLE)) AS acc, {_CNT} FROM fused WHERE label IS NOT NULL),
       (SELECT sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM (
          SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS neg_below
          FROM (SELECT probability AS s, count(*) FILTER (WHERE label = 1) AS pos,
                       count(*) FILTER (WHERE label = 0) AS neg FROM fused WHERE label IS NOT NULL GROUP BY 1)))""",
    SCORED_SQL))
def m27_evaluate(spark, sf_dir):
    return M.evaluate(_lab(spark, sf_dir))


# ------------------------------------------------------------------ O-series

_BAND = ("CASE WHEN probability >= 0.85 THEN 'CRITICAL' WHEN probability >= 0.6 THEN 'HIGH' "
         "WHEN probability >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END")
_CONF = "printf('%.1f', greatest(probability, 1 - probability) * 100) || '%'"


@query("o01_risk_band", _q(f"SELECT account_id, {_BAND} AS risk_band FROM fused"))
def o01_risk_band(spark, sf_dir):
    return fused(spark, sf_dir).select("account_id", O.risk_band(F.col("probability")).alias("risk_band"))


@query("o02_label_text", _q("SELECT account_id, CASE WHEN pred = 1 THEN 'FAKE' ELSE 'GENUINE' END AS label FROM fused"))
def o02_label_text(spark, sf_dir):
    return fused(spark, sf_dir).select("account_id", O.label_text(F.col("pred")).alias("label"))


@query("o03_confidence", _q(f"SELECT account_id, {_CONF} AS confidence FROM fused"))
def o03_confidence(spark, sf_dir):
    return fused(spark, sf_dir).select("account_id", O.confidence(F.col("probability")).alias("confidence"))


@query("o04_display_username", _q(
    "SELECT account_id, CASE WHEN username LIKE 'unknown\\_%' ESCAPE '\\' THEN replace(username, 'unknown_', '@user_') "
    "ELSE username END AS username FROM (SELECT account_id, CASE WHEN account_id % 3 = 0 THEN 'unknown_' || "
    "CAST(account_id AS VARCHAR) ELSE username END AS username FROM fused)"))
def o04_display_username(spark, sf_dir):
    """Every third account carries a surrogate `unknown_<key>` name (S07) to exercise the rewrite."""
    f = fused(spark, sf_dir)
    u = F.when(F.col("account_id") % 3 == 0, F.concat(F.lit("unknown_"), F.col("account_id").cast("string"))) \
         .otherwise(F.col("username"))
    return f.select("account_id", O.display_username(u).alias("username"))


@query("o05_result_record")
def o05_result_record(spark, sf_dir):
    return O.result_record(explained(spark, sf_dir))


# ------------------------------------------------------------------ R-series

_BONUS = ("(CASE WHEN followers / greatest(following, 1) BETWEEN 0.3 AND 5.0 THEN 0.04 ELSE 0 END"
          " + CASE WHEN followers > 100 THEN 0.03 ELSE 0 END + CASE WHEN followers > 500 THEN 0.02 ELSE 0 END"
          " + CASE WHEN has_profile_pic = 1 THEN 0.02 ELSE 0 END + CASE WHEN verified = 1 THEN 0.08 ELSE 0 END"
          " + CASE WHEN posts = 0 AND followers > 50 THEN 0.05 ELSE 0 END"
          " + CASE WHEN length(coalesce(bio, '')) > 0 AND length(coalesce(bio, '')) < 200 THEN 0.01 ELSE 0 END)")
_RECAL = f"""rc AS (SELECT account_id, raw_model_probability, {_BONUS} AS bonus
                   FROM (SELECT a.*, f.probability AS raw_model_probability
                         FROM accounts a JOIN fused f ON a.account_id = f.account_id)),
rc2 AS (SELECT account_id, raw_model_probability, bonus, {_even('adjusted', 4)} AS probability
        FROM (SELECT *, greatest(0.01, least(0.99, 0.5 + 0.2 * (raw_model_probability - 0.5) - bonus)) AS adjusted
              FROM rc))"""


def _recal(spark, sf_dir):
    from .common import acc
    a = acc(spark, sf_dir)
    f = fused(spark, sf_dir).select("account_id", "probability")
    return O.recalibrate(a.join(f, "account_id"))


@query("r01_shrink_to_prior", _q("SELECT account_id, round(0.5 + 0.2 * (probability - 0.5), 6) AS shrunk FROM fused"))
def r01_shrink_to_prior(spark, sf_dir):
    f = fused(spark, sf_dir)
    return round_doubles(f.select("account_id", (0.5 + O.SIGNAL_WEIGHT * (F.col("probability") - 0.5)).alias("shrunk")))


@query("r02_genuineness_bonus", with_accounts(f"SELECT account_id, round({_BONUS}, 6) AS bonus FROM accounts"))
def r02_genuineness_bonus(spark, sf_dir):
    from .common import acc
    a = acc(spark, sf_dir)
    b = O.genuineness_bonus(F.col("followers"), F.col("following"), F.col("posts"),
                            F.col("has_profile_pic").cast("boolean"), F.col("verified").cast("boolean"), F.col("bio"))
    return round_doubles(a.select("account_id", b.alias("bonus")))


@query("r03_recalibrate", with_accounts(
    f"""SELECT account_id, round(raw_model_probability, 6) AS raw_model_probability, probability,
          CASE WHEN probability >= 0.5 THEN 'FAKE' ELSE 'GENUINE' END AS label, {_BAND} AS risk_band,
          {_CONF} AS confidence FROM rc2""", SCORED_SQL, _RECAL))
def r03_recalibrate(spark, sf_dir):
    r = _recal(spark, sf_dir)
    return round_doubles(r.select("account_id", "raw_model_probability", "probability", "label", "risk_band",
                                  "confidence"))


@query("r04_completeness", with_accounts(
    f"SELECT account_id, {_even('least(0.55, 0.35 + bonus)', 2)} AS data_completeness FROM rc2", SCORED_SQL, _RECAL))
def r04_completeness(spark, sf_dir):
    return _recal(spark, sf_dir).select("account_id", "data_completeness")


@query("r05_age_estimate", with_accounts(
    "SELECT account_id, greatest(365, least(greatest(coalesce(posts, 0) * 7, followers * 2, following * 2), 2693)) "
    "AS account_age_days, round(coalesce(posts, 0) / greatest(365, least(greatest(coalesce(posts, 0) * 7, "
    "followers * 2, following * 2), 2693)), 6) AS posts_per_day FROM accounts"))
def r05_age_estimate(spark, sf_dir):
    from .common import acc
    a = acc(spark, sf_dir)
    posts = F.coalesce(F.col("posts"), F.lit(0.0))
    age = O.estimate_age(posts, F.col("followers"), F.col("following")).cast("double")
    return round_doubles(a.select("account_id", age.alias("account_age_days"), (posts / age).alias("posts_per_day")))


# ------------------------------------------------------------------ X-series

def _long(arr_col, df, extra=()):
    return df.select("account_id", *extra, F.posexplode(arr_col).alias("pos", "a")) \
             .select("account_id", *extra, (F.col("pos") + 1).alias("rank"), "a.*")


@query("x02_magnitude_attributions", _q("SELECT account_id, name, round(value, 6) AS value FROM attr", ATTR_SQL))
def x02_magnitude_attributions(spark, sf_dir):
    e = explained(spark, sf_dir)
    return round_doubles(_long("attributions", e).select("account_id", "name", "value"))


@query("x03_top_k_abs", _q("""SELECT account_id, rank, name, round(value, 6) AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(value) DESC, idx) AS rank FROM attr)
  WHERE rank <= 5""", ATTR_SQL))
def x03_top_k_abs(spark, sf_dir):
    e = explained(spark, sf_dir).withColumn("top", X.top_k_abs(F.col("attributions"), 5))
    return round_doubles(_long("top", e))


@query("x06_rank_estimated", _q("SELECT account_id, rank, name, round(value, 6) AS value FROM top5", ATTR_SQL))
def x06_rank_estimated(spark, sf_dir):
    return round_doubles(_long("top_attributions", explained(spark, sf_dir)))


def _annotated(spark, sf_dir):
    e = explained(spark, sf_dir)
    e = e.withColumn("ann", X.annotate(F.col("top_attributions"), X.raw_value_map(e)))
    return _long("ann", e)


@query("x08_descriptions", _q("SELECT account_id, rank, description FROM ann", ANNOT_SQL))
def x08_descriptions(spark, sf_dir):
    return _annotated(spark, sf_dir).select("account_id", "rank", "description")


@query("x09_direction", _q("SELECT account_id, rank, direction FROM ann", ANNOT_SQL))
def x09_direction(spark, sf_dir):
    return _annotated(spark, sf_dir).select("account_id", "rank", "direction")


@query("x10_estimated_flag", _q("SELECT account_id, rank, estimated FROM ann", ANNOT_SQL))
def x10_estimated_flag(spark, sf_dir):
    return _annotated(spark, sf_dir).select("account_id", "rank", "estimated")


@query("x11_impact", _q("""SELECT account_id, rank, round(pct, 6) AS pct,
    CASE WHEN direction = 'increases_fake' THEN round_even(pct, 1) ELSE round_even(-pct, 1) END AS signed_pct
  FROM ann""", ANNOT_SQL))
def x11_impact(spark, sf_dir):
    return round_doubles(_annotated(spark, sf_dir).select("account_id", "rank", "pct", "signed_pct"))


_ENTRY = ("description || CASE WHEN direction = 'increases_fake' THEN ' increases fake likelihood (impact: ' "
          "ELSE ' reduces fake likelihood (impact: ' END || printf('%.1f', pct) || '%)'")
_SUP = ("((lbl = 'FAKE' AND direction = 'increases_fake') OR (lbl = 'GENUINE' AND direction = 'decreases_fake'))")


@query("x12_explanation", _q(f"""SELECT account_id, concat_ws(' ',
     'Prediction: ' || lbl || ' (probability: ' || printf('%.2f', probability * 100) || '%, risk: '
        || band || ').',
     CASE WHEN sup IS NOT NULL THEN 'Key factors: ' || sup || '.' END,
     CASE WHEN opp IS NOT NULL THEN 'Counterevidence: ' || opp || '.' END) AS explanation
  FROM (SELECT account_id, lbl, band, probability,
               string_agg(entry, '; ' ORDER BY rank) FILTER (WHERE s AND srank <= 3) AS sup,
               string_agg(entry, '; ' ORDER BY rank) FILTER (WHERE NOT s AND srank <= 2) AS opp
        FROM (SELECT *, row_number() OVER (PARTITION BY account_id, s ORDER BY rank) AS srank FROM (
                SELECT account_id, rank, probability, lbl, {_BAND} AS band, {_ENTRY} AS entry, {_SUP} AS s FROM (
                  SELECT *, CASE WHEN pred = 1 THEN 'FAKE' ELSE 'GENUINE' END AS lbl FROM ann)))
        GROUP BY account_id, lbl, band, probability)""", ANNOT_SQL))
def x12_explanation(spark, sf_dir):
    return O.result_record(explained(spark, sf_dir)).select("account_id", "explanation")


@query("st04_one_shot_scan", _q("SELECT 'demo' AS mode, CAST(TIMESTAMP '2024-01-31 00:00:00' AS TIMESTAMP) AS scan_ts, "
                                "count(*) AS count, count(*) FILTER (WHERE pred = 1) AS n_fake FROM fused"))
def st04_one_shot_scan(spark, sf_dir):
    from ..streaming.monitor import one_shot_scan

    def score_fn(df):
        return df.select("account_id", O.label_text(F.col("pred")).alias("label"))
    _, entry = one_shot_scan(fused(spark, sf_dir), score_fn, "demo", "2024-01-31 00:00:00")
    return entry


@query("s20_fetch_and_score", _q(f"SELECT account_id, username, CASE WHEN pred = 1 THEN 'FAKE' ELSE 'GENUINE' END "
                                 f"AS label, {_BAND} AS risk_band FROM fused"))
def s20_fetch_and_score(spark, sf_dir):
    """Names = every account username plus comma-list tokens from the documents
    (unresolvable, skipped); each resolvable name is scored once."""
    from ..sources.profiles import username_list
    from ..sources.tables import Tables
    from ..streaming.monitor import fetch_and_score
    f = fused(spark, sf_dir)
    names = f.select("username").unionByName(
        Tables(spark, sf_dir).documents.select(F.explode(username_list(F.col("text"))).alias("username")))

    def score_fn(df):
        return df.select("account_id", "username", O.label_text(F.col("pred")).alias("label"),
                         O.risk_band(F.col("probability")).alias("risk_band"))
    return fetch_and_score(names, f, score_fn)
