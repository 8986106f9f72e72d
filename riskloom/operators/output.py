"""O01-O05 (risk record) and R01-R05 (recalibration for incomplete data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import explain as X
from .clean import round_half_even
from .graph import DEFAULT_GRAPH_RISK

# Risk band edges.
RISK_BANDS = [(0.85, "CRITICAL"), (0.60, "HIGH"), (0.30, "MEDIUM")]
SIGNAL_WEIGHT = 0.20


def risk_band(p: Column) -> Column:
    """O01"""
    out = F.lit("LOW")
    for edge, name in reversed(RISK_BANDS):
        out = F.when(p >= edge, F.lit(name)).otherwise(out)
    return out


def label_text(pred: Column) -> Column:
    """O02"""
    return F.when(pred == 1, F.lit("FAKE")).otherwise(F.lit("GENUINE"))


def confidence(p: Column) -> Column:
    """max(p, 1-p) as '%.1f%%'."""
    return F.concat(X.fmt(F.greatest(p, 1 - p) * 100, 1), F.lit("%"))


def display_username(u: Column | None) -> Column:
    """unknown_<n> -> @user_<n>; no username column -> 'unknown'."""
    if u is None:
        return F.lit("unknown")
    s = F.coalesce(u.cast("string"), F.lit("None"))
    return F.when(s.startswith("unknown_"), F.replace(s, F.lit("unknown_"), F.lit("@user_"))).otherwise(s)


def result_record(df: DataFrame, prob_col="probability", pred_col="pred", graph_col: str | None = None,
                  attributions_col: str | None = "top_attributions", key=("account_id",)) -> DataFrame:
    """One record per input row.  `attributions_col` holds the (already ranked)
    top attributions ARRAY<STRUCT<name, value>> in feature space."""
    p = F.col(prob_col)
    lab = label_text(F.col(pred_col))
    band = risk_band(p)
    gr = F.col(graph_col) if graph_col else F.lit(DEFAULT_GRAPH_RISK)
    if attributions_col:
        ann = X.annotate(F.col(attributions_col), X.raw_value_map(df))
    else:
        ann = F.array().cast("array<struct<raw_name:string,description:string,value:double,direction:string,"
                             "pct:double,signed_pct:double,estimated:boolean>>")
    uname = display_username(F.col("username") if "username" in df.columns else None)
    # the annotation array is projected once; every consumer reads the column
    base = df.select(*[F.col(k) for k in key if k in df.columns], uname.alias("username"),
                     lab.alias("label"), p.alias("_p"), round_half_even(gr, 4).alias("graph_risk"),
                     band.alias("risk_band"), ann.alias("_ann"))
    return base.select(
        *[k for k in key if k in df.columns], "username", "label", round_half_even(F.col("_p"), 4).alias("probability"),
        "graph_risk", "risk_band", confidence(F.col("_p")).alias("confidence"),
        F.transform("_ann", lambda a: a["description"]).alias("top_features"),
        F.transform("_ann", lambda a: F.struct(a["raw_name"].alias("raw_name"),
                                               a["description"].alias("description"),
                                               a["signed_pct"].alias("signed_pct"))).alias("top_shap_values"),
        F.transform("_ann", lambda a: F.struct(a["description"].alias("name"), a["signed_pct"].alias("impact"),
                                               a["direction"].alias("direction"),
                                               a["estimated"].alias("estimated"))).alias("annotated_features"),
        X.explanation(F.col("label"), F.col("_p"), F.col("risk_band"), F.col("_ann")).alias("explanation"))


# --- R01-R05 ------------------------------------------------------------------------

def genuineness_bonus(followers: Column, following: Column, posts: Column, has_pic: Column,
                      verified: Column, bio: Column) -> Column:
    """Profile-based bonus (each rule adds a fixed amount)."""
    ratio = followers / F.greatest(following, F.lit(1))
    blen = F.length(F.coalesce(bio, F.lit("")))
    rules = [(((ratio >= 0.3) & (ratio <= 5.0)), 0.04), (followers > 100, 0.03), (followers > 500, 0.02),
             (has_pic, 0.02), (verified, 0.08), (((posts == 0) & (followers > 50)), 0.05),
             (((blen > 0) & (blen < 200)), 0.01)]
    return sum(F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0)) for c, v in rules)


def recalibrate(df: DataFrame, prob_col="probability") -> DataFrame:
    """Shrink to the prior, subtract the bonus, clamp, round 4, relabel at .5,
    new band/confidence; completeness = round(min(.55, .35+bonus), 2); keep raw p.
    Expects followers, following, posts, has_profile_pic, verified, bio columns."""
    bonus = genuineness_bonus(F.col("followers"), F.col("following"), F.col("posts"),
                              F.col("has_profile_pic").cast("boolean"), F.col("verified").cast("boolean"),
                              F.col("bio"))
    raw = F.col(prob_col)
    adj = 0.5 + SIGNAL_WEIGHT * (raw - 0.5) - F.col("_bonus")
    adj = round_half_even(F.greatest(F.lit(0.01), F.least(F.lit(0.99), adj)), 4)
    out = df.withColumn("_bonus", bonus).withColumn("raw_model_probability", raw) \
        .withColumn(prob_col, adj)
    return (out.withColumn("label", label_text((F.col(prob_col) >= 0.5).cast("int")))
            .withColumn("risk_band", risk_band(F.col(prob_col)))
            .withColumn("confidence", confidence(F.col(prob_col)))
            .withColumn("data_completeness", round_half_even(F.least(F.lit(0.55), 0.35 + F.col("_bonus")), 2))
            .drop("_bonus"))


def estimate_age(posts: Column, followers: Column, following: Column) -> Column:
    """clamp(max(posts*7, followers*2, following*2), 365, 2693)."""
    return F.greatest(F.lit(365), F.least(F.greatest(posts * 7, followers * 2, following * 2), F.lit(2693)))
