"""Attribution post-processing as array expressions.

Everything stays inside the row (no shuffle): attributions are an
ARRAY<STRUCT<name, value>> column; sorting, slicing, descriptions, directions
and the sentence are higher-order array functions.  The description tables
are small literal maps (fixed size, embedded in the plan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

# Fixed values that must equal the reference: feature descriptions.
FEATURE_DESCRIPTIONS = {
    "has_profile_pic": "Whether the account has a profile picture",
    "bio_length": "Length of the biography text in characters",
    "username_randomness": "Whether the username appears random/bot-generated",
    "followers": "Total number of followers",
    "following": "Total number of accounts followed",
    "follower_following_ratio": "Ratio of followers to following count",
    "account_age_days": "Age of the account in days",
    "posts": "Total number of posts",
    "posts_per_day": "Average posts published per day",
    "caption_similarity_score": "Similarity between post captions (high → repetitive content)",
    "content_similarity_score": "Visual/content similarity score across posts",
    "follow_unfollow_rate": "Rate of follow/unfollow cycling behaviour",
    "spam_comments_rate": "Fraction of comments classified as spam",
    "generic_comment_rate": "Fraction of generic/templated comments",
    "suspicious_links_in_bio": "Presence of suspicious external links in bio",
    "verified": "Whether the account is verified by the platform",
    "username_entropy": "Shannon entropy of the username (randomness measure)",
    "username_length": "Length of the username string",
    "digits_count": "Number of digit characters in the username",
    "digit_ratio": "Fraction of digits in the username",
    "special_char_count": "Number of non-alphanumeric characters in username",
    "repeat_char_count": "Number of consecutively repeated characters in username",
    "bio_has_url": "Whether the biography contains a URL",
    "bio_spam_score": "Count of spam keywords found in the biography",
    "follow_diff": "Difference between followers and following counts",
    "followers_ratio": "Followers as a fraction of total connections",
    "activity_rate": "Post activity relative to follower count",
    "log_followers": "Log-transformed follower count (reduces skew)",
    "log_posts": "Log-transformed post count (reduces skew)",
    "account_hour": "Estimated creation hour derived from account age",
    "account_weekend": "Whether account appears to have been created on a weekend",
    "listed_ratio": "Listed count relative to followers",
    "likes_per_post": "Average likes per post",
    "verified_low_follow": "Unverified account with fewer than 100 followers flag",
    "community_size_ratio": "Community size ratio in social graph",
    "degree_centrality": "Degree centrality in social graph",
}

# Descriptions used when the raw profile value is 0 / false / "".
FEATURE_DESCRIPTIONS_ZERO = {
    "bio_length": "Empty biography (no bio text)",
    "suspicious_links_in_bio": "No suspicious external links in bio",
    "bio_has_url": "No URL in biography",
    "bio_spam_score": "No spam keywords in biography",
    "has_profile_pic": "No profile picture set",
    "verified": "Account is not verified",
    "posts": "No posts published",
    "followers": "Zero followers",
    "following": "Not following anyone",
    "log_posts": "No posts (log-transformed)",
    "log_followers": "No followers (log-transformed)",
    "verified_low_follow": "Account is verified or has 100+ followers",
}

# Direction of a zero-valued feature (True = zero is a fake signal).
FEATURE_ZERO_IS_FAKE_SIGNAL = {
    "bio_length": True, "has_profile_pic": True, "verified": True, "posts": True,
    "log_posts": True, "followers": True, "log_followers": True, "following": True,
    "suspicious_links_in_bio": False, "bio_spam_score": False, "bio_has_url": False,
}

# Features that are estimated (defaulted) at inference time.
ESTIMATED_FEATURES = [
    "caption_similarity_score", "content_similarity_score", "follow_unfollow_rate",
    "spam_comments_rate", "generic_comment_rate", "account_age_days", "posts_per_day",
    "activity_rate", "username_randomness", "account_hour", "account_weekend",
    "listed_ratio", "likes_per_post",
]
ESTIMATED_WEIGHT = 0.3


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def magnitude_attributions(names: list[str], values: list[Column], scale: float = 0.01) -> Column:
    """Value x 0.01 per component/feature, as ARRAY<STRUCT<name, value>>."""
    return F.array(*[F.struct(F.lit(n).alias("name"), (v * scale).alias("value"))
                     for n, v in zip(names, values)])


def _top_by(arr: Column, weight, k: int) -> Column:
    """The k entries of largest weight(entry), equal weights in input order.  The
    weight is worked out once per entry, not in every comparison."""
    keyed = F.transform(arr, lambda x, i: F.struct(weight(x).alias("w"), (-i).alias("at"), x["name"].alias("name"),
                                                   x["value"].alias("value")))

    def cmp(l, r):
        return F.when(l["w"] > r["w"], F.lit(-1)).when(l["w"] < r["w"], F.lit(1)).otherwise(r["at"] - l["at"])

    # (w, at) downwards is the order that cmp gives, which is interpreted per comparison and decides where weights are null
    top = let(keyed, lambda a: F.when(F.exists(a, lambda x: x["w"].isNull()), F.array_sort(a, cmp)).otherwise(F.sort_array(a, asc=False)))
    return F.transform(F.slice(top, 1, k), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def top_k_abs(arr: Column, k: int = 5) -> Column:
    """Top-k by |value| desc; equal magnitudes keep input order (stable)."""
    return _top_by(arr, lambda x: F.abs(x["value"]), k)


def back_project(component_values: Column, loadings: list[list[float]], feature_names: list[str]) -> Column:
    """S . V  (K components x D loadings) -> ARRAY<STRUCT<name, value>> in
    feature space.  V (K x D doubles, bounded by the model) goes to the tasks."""
    from ..functions.udfs import loading_sums
    values = loading_sums(loadings)(*[F.coalesce(component_values[k], F.lit(0.0)) for k in range(len(loadings))])
    names = F.array(*[F.lit(n) for n in feature_names])
    return F.transform(values, lambda v, j: F.struct(names[j].alias("name"), v.alias("value")))


def rank_estimated(arr: Column, k: int = 10, weight: float = ESTIMATED_WEIGHT) -> Column:
    """Sort by |value| with estimated features down-weighted by 0.3; keep the
    true value; top k."""
    est = F.array(*[F.lit(n) for n in ESTIMATED_FEATURES])

    return _top_by(arr, lambda x: F.abs(x["value"]) * F.when(F.array_contains(est, x["name"]), F.lit(weight))
                   .otherwise(F.lit(1.0)), k)


def raw_value_map(df: DataFrame) -> Column:
    """Raw profile values of the zero-description features present in the input."""
    cols = [c for c in FEATURE_DESCRIPTIONS_ZERO if c in df.columns]
    if not cols:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).try_cast("double"))])


def annotate(arr: Column, raw: Column) -> Column:
    """Per attribution: description (zero variant when the raw value is 0),
    direction (zero override table), estimated flag and signed impact %
    (|v| / sum|v| * 100, 1 decimal half-even)."""
    desc, zdesc, zfake = _lit_map(FEATURE_DESCRIPTIONS), _lit_map(FEATURE_DESCRIPTIONS_ZERO), \
        _lit_map(FEATURE_ZERO_IS_FAKE_SIGNAL)
    est = F.array(*[F.lit(n) for n in ESTIMATED_FEATURES])
    est_desc = F.array(*[F.lit(FEATURE_DESCRIPTIONS[n]) for n in ESTIMATED_FEATURES])

    # the array, its total and the raw values are bound once per row, what an entry needs twice once per entry
    def whole(a):
        total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.abs(x["value"]))
        return let(F.struct(F.when(total == 0, F.lit(1.0)).otherwise(total).alias("total"), raw.alias("raw")),
                   lambda row: F.transform(F.transform(F.transform(a, lambda x: zero(x, row)), directed), one))

    def zero(x, row):
        z = F.coalesce(row["raw"][x["name"]] == 0, F.lit(False)) & zdesc[x["name"]].isNotNull()
        return F.struct(x["name"].alias("name"), x["value"].alias("value"), z.alias("is_zero"), zfake[x["name"]].alias("zf"),
                        (F.abs(x["value"]) / row["total"] * 100).alias("pct"))

    def directed(x):
        d = F.when(x["is_zero"], zdesc[x["name"]]).otherwise(F.coalesce(desc[x["name"]], x["name"]))
        shap_dir = F.when(x["value"] > 0, F.lit("increases_fake")).otherwise(F.lit("decreases_fake"))
        direction = (F.when(x["is_zero"] & x["zf"].isNotNull(),
                            F.when(x["zf"], F.lit("increases_fake")).otherwise(F.lit("decreases_fake")))
                     .otherwise(shap_dir))
        return F.struct(x["name"].alias("name"), x["value"].alias("value"), x["pct"].alias("pct"), d.alias("d"),
                        direction.alias("direction"))

    def one(x):
        signed = F.when(x["direction"] == "increases_fake", F.bround(x["pct"], 1)).otherwise(F.bround(-x["pct"], 1))
        return F.struct(x["name"].alias("raw_name"), x["d"].alias("description"), x["value"].alias("value"),
                        x["direction"].alias("direction"), x["pct"].alias("pct"), signed.alias("signed_pct"),
                        (F.array_contains(est, x["name"]) | F.array_contains(est_desc, x["d"])).alias("estimated"))
    return let(arr, whole)


def fmt(x: Column, digits: int) -> Column:
    """Python-style fixed format ('%.Nf' on the exact binary value, trap T8)."""
    from ..functions.columns import py_fixed
    return py_fixed(x, digits)


def explanation(label: Column, prob: Column, band: Column, ann: Column,
                completeness: Column | None = None) -> Column:
    """Head sentence; up to 5 factors split into supporting (<=3) and
    opposing (<=2); low-data warning when completeness < 0.6."""
    head = F.concat(F.lit("Prediction: "), label, F.lit(" (probability: "), fmt(prob * 100, 2),
                    F.lit("%, risk: "), band, F.lit(")."))
    five = F.slice(ann, 1, 5)

    def entry(x):
        verb = F.when(x["direction"] == "increases_fake", F.lit(" increases fake likelihood (impact: ")) \
                .otherwise(F.lit(" reduces fake likelihood (impact: "))
        return F.concat(x["description"], verb, fmt(x["pct"], 1), F.lit("%)"))

    def supports(x):
        return (((label == "FAKE") & (x["direction"] == "increases_fake"))
                | ((label == "GENUINE") & (x["direction"] == "decreases_fake")))
    sup = F.slice(F.transform(F.filter(five, supports), entry), 1, 3)
    opp = F.slice(F.transform(F.filter(five, lambda x: ~supports(x)), entry), 1, 2)
    parts = [head,
             F.when(F.size(sup) > 0, F.concat(F.lit("Key factors: "), F.array_join(sup, "; "), F.lit("."))),
             F.when(F.size(opp) > 0, F.concat(F.lit("Counterevidence: "), F.array_join(opp, "; "), F.lit(".")))]
    if completeness is not None:
        parts.append(F.when(completeness < 0.6, F.concat(
            F.lit("⚠ Limited data available ("), fmt(completeness * 100, 0),
            F.lit("%) — prediction reliability is reduced."))))
    return F.concat_ws(" ", *parts)
