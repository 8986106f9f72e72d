"""Queries for the cleaning operators (P-series)."""

from pyspark.sql import functions as F

from ..operators import clean as C
from ..sources.tables import Tables
from .common import acc, round_doubles, with_accounts
from .registry import query

ACC_NUMERIC = ["bio_length", "followers", "following", "posts", "account_age_days", "verified",
               "has_profile_pic", "follow_unfollow_rate", "spam_comments_rate", "generic_comment_rate",
               "caption_similarity_score"]
ACC_CONST_COLS = ["account_id"] + ACC_NUMERIC

_WS = C.WS_CLASS.replace("\\\\", "\\")


@query("p07_dedup", "SELECT DISTINCT text, lang, source, n_chars FROM documents")
def p07_dedup(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("text", "lang", "source", "n_chars")
    return C.dedup(d, ["text", "lang", "source", "n_chars"])


@query("p08_constant_columns", with_accounts("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(min({c}) IS NOT DISTINCT FROM max({c}) AS INTEGER) AS is_constant "
    f"FROM accounts" for c in ACC_CONST_COLS)))
def p08_constant_columns(spark, sf_dir):
    return C.constant_column_report(acc(spark, sf_dir).select(*ACC_CONST_COLS, "label", "username", "bio"))


@query("p09_strip", f"SELECT conv_id, turn, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS text "
                    "FROM conversations")
def p09_strip(spark, sf_dir):
    return C.strip_strings(Tables(spark, sf_dir).conversations.select("conv_id", "turn", "text"), ["text"])


_P10_Q = ",\n".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3"
                    for c in ACC_NUMERIC)
_P10_SEL = ",\n".join(
    f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), "
    f"{c}_q1 - 5 * ({c}_q3 - {c}_q1)), {c}_q3 + 5 * ({c}_q3 - {c}_q1)) END, 6) AS {c}" for c in ACC_NUMERIC)


@query("p10_iqr_cap", with_accounts(f"SELECT account_id, {_P10_SEL} FROM accounts, q",
                                     f"q AS (SELECT {_P10_Q} FROM accounts)"))
def p10_iqr_cap(spark, sf_dir):
    a = acc(spark, sf_dir).select("account_id", *ACC_NUMERIC)
    return round_doubles(C.iqr_cap(a, ACC_NUMERIC))


@query("p11_zero_width", "SELECT doc_id, regexp_replace(text, '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{00AD}]', '', 'g')"
                         " AS text FROM documents")
def p11_zero_width(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", C.remove_zero_width(F.col("text")).alias("text"))


@query("p12_nfkc")
def p12_nfkc(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", C.nfkc(F.col("text")).alias("text"))


@query("p13_leet_fold", "SELECT c_custkey, translate(c_name, '013457@$', 'oieastas') AS username FROM customer")
def p13_leet_fold(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    return c.select("c_custkey", C.leet_fold(F.col("c_name")).alias("username"))


@query("p14_adversarial_normalise")
def p14_adversarial_normalise(spark, sf_dir):
    a = acc(spark, sf_dir).select("account_id", "username", "bio")
    return C.adversarial_normalise(a)


_ENT = ("CASE WHEN u = '' OR u = 'nan' THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split(u, '')), "
        "lambda ch: ((length(u) - length(replace(u, ch, ''))) / length(u)) * "
        "log2((length(u) - length(replace(u, ch, ''))) / length(u)))) END")


@query("p15_username_entropy", with_accounts(
    f"SELECT account_id, round({_ENT}, 6) AS username_entropy FROM (SELECT account_id, coalesce(username, '') AS u "
    "FROM accounts)"))
def p15_username_entropy(spark, sf_dir):
    a = acc(spark, sf_dir).select("account_id", "username")
    return round_doubles(C.add_username_entropy(a).select("account_id", "username_entropy"))


@query("p16_mode", "\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS mode, count(*) AS mode_count "
    f"FROM documents WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY mode_count DESC, mode LIMIT 1)"
    for c in ("lang", "source")))
def p16_mode(spark, sf_dir):
    return C.modes(Tables(spark, sf_dir).documents, ["lang", "source"])


@query("p16_mode_impute", with_accounts(
    "SELECT account_id, coalesce(bio_lang, (SELECT lang FROM documents GROUP BY lang "
    "ORDER BY count(*) DESC, lang LIMIT 1)) AS bio_lang FROM "
    "(SELECT a.account_id, d.lang AS bio_lang FROM accounts a LEFT JOIN documents d ON d.doc_id = a.account_id)"))
def p16_mode_impute(spark, sf_dir):
    """Accounts without a bio get the most frequent bio language."""
    t = Tables(spark, sf_dir)
    a = acc(spark, sf_dir).select("account_id")
    d = t.documents.select(F.col("doc_id").alias("account_id"), F.col("lang").alias("bio_lang"))
    m = C.modes(t.documents, ["lang"]).select("mode").scalar()
    return a.join(d, "account_id", "left").select("account_id", F.coalesce("bio_lang", m).alias("bio_lang"))


@query("p19_floor_filter", with_accounts(
    "SELECT account_id, followers, posts FROM accounts WHERE label = 0 AND followers >= 500 AND posts >= 10"))
def p19_floor_filter(spark, sf_dir):
    """Genuine rows above a follower floor (500, as in the reference) and a post floor
    (10 here: the driver data has about ten orders per customer)."""
    a = acc(spark, sf_dir)
    return a.where((F.col("label") == 0) & (F.col("followers") >= 500) & (F.col("posts") >= 10)) \
            .select("account_id", "followers", "posts")


@query("p20_falsy_default", with_accounts(
    "SELECT account_id, CASE WHEN posts IS NULL OR posts = 0 THEN 1.0 ELSE posts END AS posts, "
    "CASE WHEN follow_unfollow_rate IS NULL OR follow_unfollow_rate = 0 THEN 68 ELSE follow_unfollow_rate END "
    "AS follow_unfollow_rate, CASE WHEN bio IS NULL OR bio = '' THEN 'none' ELSE left(bio, 0) || 'some' END AS bio_state "
    "FROM accounts"))
def p20_falsy_default(spark, sf_dir):
    a = acc(spark, sf_dir)
    return a.select("account_id", C.falsy_default(F.col("posts"), 1.0).alias("posts"),
                    C.falsy_default(F.col("follow_unfollow_rate"), 68).alias("follow_unfollow_rate"),
                    F.when(C.falsy_default_str(F.col("bio"), "none") == "none", "none").otherwise("some")
                    .alias("bio_state"))


@query("p21_round_half_even", with_accounts(
    "SELECT account_id, round_even(caption_similarity_score, 2) AS caption_2, "
    "round_even(following / 7, 1) AS following_per_week FROM accounts"))
def p21_round_half_even(spark, sf_dir):
    a = acc(spark, sf_dir)
    return a.select("account_id", C.round_half_even(F.col("caption_similarity_score"), 2).alias("caption_2"),
                    C.round_half_even(F.col("following") / 7, 1).alias("following_per_week"))


_IMP = ["bio_length", "posts", "account_age_days", "follow_unfollow_rate", "spam_comments_rate",
        "generic_comment_rate", "caption_similarity_score", "followers", "following"]


@query("p17_mean_start", with_accounts(
    "SELECT account_id, " + ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), avg({c}) OVER ()), 6) AS {c}"
                                      for c in _IMP) + " FROM accounts"))
def p17_mean_start(spark, sf_dir):
    from ..operators.impute import mean_start
    a = acc(spark, sf_dir).select("account_id", *_IMP)
    return round_doubles(mean_start(a, _IMP).select("account_id", *_IMP))


@query("p17_chained_impute")
def p17_chained_impute(spark, sf_dir):
    """Three rounds here (the operator default is the reference's ten)."""
    from ..operators.impute import impute_chained
    a = acc(spark, sf_dir).select("account_id", *_IMP)
    return impute_chained(a, _IMP, max_iter=3)


@query("p05_guarded_ratio", with_accounts(
    "SELECT account_id, round(CASE WHEN following > 0 THEN followers / following ELSE 0.0 END, 6) AS ratio, "
    "round(CASE WHEN posts > 0 THEN following / posts ELSE 0.0 END, 6) AS per_post FROM accounts"))
def p05_guarded_ratio(spark, sf_dir):
    from ..functions.columns import guarded_ratio
    a = acc(spark, sf_dir)
    return round_doubles(a.select("account_id", guarded_ratio(F.col("followers"), F.col("following")).alias("ratio"),
                                  guarded_ratio(F.col("following"), F.col("posts")).alias("per_post")))


@query("p06_url_flag", "SELECT page_id, CAST(regexp_matches(coalesce(html, ''), 'http[s]?://|www\\.') AS INTEGER) AS "
                       "has_url FROM pages")
def p06_url_flag(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    return p.select("page_id", C.url_flag(F.col("html")).alias("has_url"))


@query("p18_clip", with_accounts(
    "SELECT account_id, CASE WHEN caption_similarity_score IS NULL THEN NULL ELSE "
    "round(least(greatest(caption_similarity_score, 0), 1), 6) END AS caption_01, "
    "CASE WHEN posts IS NULL THEN NULL ELSE least(posts, 100) END AS posts_max_100, "
    "CASE WHEN account_age_days IS NULL THEN NULL ELSE greatest(account_age_days, 1) END AS age_min_1 FROM accounts"))
def p18_clip(spark, sf_dir):
    from ..functions.columns import clip
    a = acc(spark, sf_dir)
    return round_doubles(a.select("account_id", clip(F.col("caption_similarity_score"), 0.0, 1.0).alias("caption_01"),
                                  clip(F.col("posts"), None, 100.0).alias("posts_max_100"),
                                  clip(F.col("account_age_days"), 1.0, None).alias("age_min_1")))
