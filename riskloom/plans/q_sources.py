"""Queries for sources and sinks (S01-S19).  File-based loaders read CSVs that
Spark first writes from the driver tables into the shared scratch folder."""

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import profiles as PR
from ..sources import readers as RD
from ..sources.tables import Tables
from .common import acc, round_doubles, with_accounts
from .registry import query


def _path(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def eval_rows(spark, sf_dir):
    """Accounts in the 20-column evaluation layout (+ account_id)."""
    a = acc(spark, sf_dir).where(F.col("label").isNotNull())
    t = Tables(spark, sf_dir)
    c = t.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("platform"))
    return a.join(c, "account_id").select(
        "account_id", "platform", "has_profile_pic", "bio_length", "followers", "following",
        (F.col("followers") / F.greatest(F.col("following"), F.lit(1.0))).alias("follower_following_ratio"),
        "account_age_days", "posts", (F.col("posts") / F.col("account_age_days")).alias("posts_per_day"),
        "caption_similarity_score", "follow_unfollow_rate", "spam_comments_rate", "generic_comment_rate",
        "verified", F.col("label").alias("is_fake"), "username", "bio")


EVAL_SQL = """ev AS (SELECT a.account_id, c.c_mktsegment AS platform, has_profile_pic, bio_length, followers, following,
    followers / greatest(following, 1.0) AS follower_following_ratio, account_age_days, posts,
    posts / account_age_days AS posts_per_day, caption_similarity_score, follow_unfollow_rate, spam_comments_rate,
    generic_comment_rate, verified, label AS is_fake, username, bio
  FROM accounts a JOIN customer c ON c.c_custkey = a.account_id WHERE label IS NOT NULL)"""
_NUM = ["has_profile_pic", "bio_length", "followers", "following", "follower_following_ratio", "account_age_days",
        "posts", "posts_per_day", "caption_similarity_score", "follow_unfollow_rate", "spam_comments_rate",
        "generic_comment_rate", "verified"]
_NUM_SQL = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _NUM)


def _write_eval(spark, sf_dir):
    p = _path(spark, "eval_csv")
    RD.write_eval_csv(eval_rows(spark, sf_dir).withColumn("account_id", F.col("account_id")), p)
    return p


def _write_eval_with_key(spark, sf_dir):
    p = _path(spark, "eval_csv")
    RD.write_eval_csv(eval_rows(spark, sf_dir), p, extra=("account_id",))
    return p


@query("s01_labelled_csv", with_accounts(
    f"SELECT account_id, {_NUM_SQL}, is_fake AS label, '' AS bio, 'unknown_' || CAST(account_id AS VARCHAR) AS username, "
    "'primary' AS _source FROM ev", EVAL_SQL))
def s01_labelled_csv(spark, sf_dir):
    df = RD.load_labelled(spark, _write_eval_with_key(spark, sf_dir), key="account_id")
    return round_doubles(df.select(F.col("account_id").cast("long").alias("account_id"), *_NUM, "label", "bio",
                                   "username", "_source"))


def _supplier_dump(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    d = t.documents.select("doc_id", "text")
    sup = t.supplier
    s = sup.join(li, sup.s_suppkey == li.l_suppkey, "left").join(d, F.col("s_suppkey") == F.col("doc_id"), "left")
    return s.select(F.col("s_name").alias("screen_name"), F.col("text").alias("description"),
                    F.floor("s_acctbal").cast("string").alias("followers_count"),
                    F.col("n_lines").cast("string").alias("friends_count"),
                    F.col("qty").cast("string").alias("statuses_count"),
                    (F.col("s_acctbal") > 9000).cast("int").cast("string").alias("verified"),
                    (F.col("s_acctbal") < 0).cast("int").cast("string").alias("default_profile_image"))


_DUMP_SQL = """dump AS (SELECT s_name AS screen_name, d.text AS description, CAST(floor(s_acctbal) AS DOUBLE) AS fc,
    CAST(li.n_lines AS DOUBLE) AS fr, li.qty AS st, CAST(s_acctbal > 9000 AS INTEGER) AS ver,
    CAST(s_acctbal < 0 AS INTEGER) AS dpi
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) li
    ON li.l_suppkey = s_suppkey LEFT JOIN documents d ON d.doc_id = s_suppkey)"""


@query("s02_follower_dump", f"""WITH {_DUMP_SQL}
SELECT coalesce(screen_name, '') AS username, coalesce(description, '') AS bio, coalesce(fc, 0) AS followers,
  coalesce(fr, 0) AS following, round(coalesce(st, 0), 6) AS posts, CAST(coalesce(ver, 0) AS DOUBLE) AS verified,
  1 - least(greatest(CAST(coalesce(dpi, 1) AS DOUBLE), 0), 1) AS has_profile_pic,
  round(CASE WHEN coalesce(fr, 0) > 0 THEN coalesce(fc, 0) / coalesce(fr, 0) ELSE 0.0 END, 6) AS follower_following_ratio,
  CAST(length(coalesce(description, '')) AS DOUBLE) AS bio_length,
  CAST(regexp_matches(coalesce(description, ''), 'http[s]?://|www\\.') AS INTEGER) AS suspicious_links_in_bio,
  1 AS label, 'twitter_fake' AS _source FROM dump""")
def s02_follower_dump(spark, sf_dir):
    p = _path(spark, "follower_dump")
    _supplier_dump(spark, sf_dir).write.mode("overwrite").option("header", True).option("escape", '"').csv(p)
    df = RD.load_follower_dump(spark, p)
    return round_doubles(df.select("username", "bio", "followers", "following", "posts", "verified",
                                   "has_profile_pic", "follower_following_ratio", "bio_length",
                                   "suspicious_links_in_bio", "label", "_source"))


def _multiclass(spark, sf_dir):
    a = acc(spark, sf_dir)
    return a.select(
        "account_id", F.col("followers").cast("string").alias("Followers"),
        F.col("following").cast("string").alias("Following"),
        F.when(F.col("followers") > 0, F.col("following") / F.col("followers")).cast("string")
        .alias("Following/Followers"),
        F.col("posts").cast("string").alias("Posts"),
        F.when(F.col("followers") > 0, F.col("posts") / F.col("followers")).cast("string").alias("Posts/Followers"),
        F.when(F.col("bio").isNull(), F.lit("N")).otherwise(F.lit(" y ")).alias("Bio"),
        F.when(F.col("has_profile_pic") == 1, F.lit("Yes")).otherwise(F.lit("n")).alias("Profile Picture"),
        F.when(F.col("verified") == 1, F.lit("y")).otherwise(F.lit("N")).alias("External Link"),
        F.when(F.col("label") == 0, F.lit(" Real")).when(F.col("label") == 1, F.lit("Bot"))
        .otherwise(F.lit("Spam")).alias("Labels"))


@query("s03_multiclass_csv", with_accounts("""SELECT account_id, coalesce(followers, 0) AS followers,
    coalesce(following, 0) AS following,
    round(coalesce(CASE WHEN followers > 0 THEN following / followers END, 0), 6) AS following_per_follower,
    coalesce(posts, 0) AS posts, round(coalesce(CASE WHEN followers > 0 THEN posts / followers END, 0), 6)
      AS posts_per_follower,
    CASE WHEN bio IS NULL THEN 0 ELSE 80 END AS bio_length, CAST(has_profile_pic = 1 AS INTEGER) AS has_profile_pic,
    CAST(verified = 1 AS INTEGER) AS suspicious_links_in_bio, 'limfadd_' || CAST(account_id AS VARCHAR) AS username,
    CASE WHEN label = 0 THEN 0 ELSE 1 END AS label, 'limfadd' AS _source FROM accounts"""))
def s03_multiclass_csv(spark, sf_dir):
    p = _path(spark, "multiclass")
    _multiclass(spark, sf_dir).write.mode("overwrite").option("header", True).option("escape", '"').csv(p)
    df = RD.load_multiclass(spark, p, key="account_id")
    return round_doubles(df.select(F.col("account_id").cast("long").alias("account_id"), "followers", "following",
                                   "following_per_follower", "posts", "posts_per_follower", "bio_length",
                                   "has_profile_pic", "suspicious_links_in_bio", "username", "label", "_source"))


def _spreadsheet(spark, sf_dir):
    """Accounts exported with a `label` column only (no is_fake), missing values kept."""
    a = acc(spark, sf_dir)
    return a.select("account_id", "followers", "following", "posts", "account_age_days",
                    F.when(F.col("label").isNull(), F.lit("unknown")).otherwise(F.col("label").cast("string"))
                    .alias("label"))


@query("s04_spreadsheet_export", with_accounts("""SELECT account_id, followers, following, posts, account_age_days,
    coalesce(label, 1) AS label, 'excel_' || CAST(account_id AS VARCHAR) AS username, '' AS bio,
    'excel_global' AS _source FROM accounts"""))
def s04_spreadsheet_export(spark, sf_dir):
    p = _path(spark, "spreadsheet")
    _spreadsheet(spark, sf_dir).write.mode("overwrite").option("header", True).csv(p)
    df = RD.load_spreadsheet_export(spark, p, key="account_id")
    return df.select(F.col("account_id").cast("long").alias("account_id"), "followers", "following", "posts",
                     "account_age_days", "label", "username", "bio", "_source")


def _all_sources(spark, sf_dir):
    p1 = _write_eval_with_key(spark, sf_dir)
    p2 = _path(spark, "follower_dump")
    _supplier_dump(spark, sf_dir).write.mode("overwrite").option("header", True).option("escape", '"').csv(p2)
    p3 = _path(spark, "multiclass")
    _multiclass(spark, sf_dir).write.mode("overwrite").option("header", True).option("escape", '"').csv(p3)
    p4 = _path(spark, "spreadsheet")
    _spreadsheet(spark, sf_dir).write.mode("overwrite").option("header", True).csv(p4)
    missing = _path(spark, "does-not-exist")
    return RD.load_datasets(spark, [
        (lambda s, p: RD.load_labelled(s, p, key="account_id"), p1),
        (lambda s, p: RD.load_spreadsheet_export(s, p, key="account_id"), p4),
        (RD.load_follower_dump, p2),
        (lambda s, p: RD.load_multiclass(s, p, key="account_id"), p3),
        (RD.load_follower_dump, missing)])


_S05 = """SELECT 'primary' AS _source, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_fake FROM accounts
  WHERE label IS NOT NULL
UNION ALL SELECT 'excel_global', count(*), count(*) FILTER (WHERE coalesce(label, 1) = 1) FROM accounts
UNION ALL SELECT 'twitter_fake', count(*), count(*) FROM supplier
UNION ALL SELECT 'limfadd', count(*), count(*) FILTER (WHERE label IS NULL OR label = 1) FROM accounts"""


@query("s05_load_datasets", with_accounts(_S05))
def s05_load_datasets(spark, sf_dir):
    u = _all_sources(spark, sf_dir)
    return u.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_fake"))


@query("s06_provenance_columns", with_accounts(
    "SELECT _source, CAST(n_cols AS BIGINT) AS n_cols FROM (VALUES ('primary', 1), ('excel_global', 1), "
    "('twitter_fake', 1), ('limfadd', 1)) v(_source, n_cols)"))
def s06_provenance_columns(spark, sf_dir):
    """Every source row carries exactly one provenance value after the open union."""
    u = _all_sources(spark, sf_dir)
    return u.groupBy("_source").agg(F.count_distinct("_source").cast("long").alias("n_cols"))


@query("s07_surrogate_username", with_accounts(
    "SELECT 'unknown_' || CAST(row_number() OVER () - 1 AS VARCHAR) AS username FROM accounts WHERE label IS NOT NULL"))
def s07_surrogate_username(spark, sf_dir):
    """No natural key in the file: consecutive scan-order index (distributed prefix count)."""
    p = _path(spark, "eval_nokey")
    RD.write_eval_csv(eval_rows(spark, sf_dir), p)
    return RD.load_labelled(spark, p, key=None).select("username")


@query("s08_evaluation_csv", with_accounts(
    f"SELECT platform, {_NUM_SQL}, CAST(is_fake AS INTEGER) AS is_fake, username, bio FROM ev", EVAL_SQL))
def s08_evaluation_csv(spark, sf_dir):
    p = _path(spark, "eval_csv")
    RD.write_eval_csv(eval_rows(spark, sf_dir), p)
    df = RD.load_evaluation(spark, p)
    return round_doubles(df.select("platform", *_NUM, "is_fake", "username", "bio"))


_S09 = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS name, count(*) AS n_rows, "
    + (f"count({c}) AS n_values, round(coalesce(sum(CAST({c} AS DOUBLE)), 0), 4) AS total FROM ev" if c in [*_NUM, "is_fake"]
       else f"count({c}) AS n_values, 0.0 AS total FROM ev" if c in ("platform", "username", "bio")
       else "0 AS n_values, 0.0 AS total FROM ev") for i, c in enumerate(RD.EVAL_COLUMNS))


@query("s09_csv_sink_columns", with_accounts(_S09, EVAL_SQL))
def s09_csv_sink_columns(spark, sf_dir):
    """The whole written file read back by position: the 20 columns in their order, their values counted and summed."""
    p = _path(spark, "eval_csv")
    RD.write_eval_csv(eval_rows(spark, sf_dir), p)
    raw = RD.read_csv_strings(spark, p)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in raw.columns])
    text = ["platform", "username", "bio"]
    total = F.sum(F.when(~F.col("name").isin(text), F.col("value").try_cast("double")))
    return (raw.select(F.posexplode(cells).alias("position", "c")).select("position", "c.*").groupBy("position", "name")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"),
                 F.round(F.coalesce(total, F.lit(0.0)), 4).alias("total")))


# ------------------------------------------------------------------ S13-S19

def _payloads(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = acc(spark, sf_dir)
    c = t.customer.select(F.col("c_custkey").alias("account_id"), "c_mktsegment")
    pg = t.pages.select(F.col("page_id").alias("account_id"), F.col("url").alias("page_url"))
    j = a.join(c, "account_id").join(pg, "account_id", "left")
    user = F.struct(
        F.col("username"), F.col("c_mktsegment").alias("full_name"), F.col("bio").alias("biography"),
        F.when(F.col("has_profile_pic") == 1, F.concat(F.lit("https://img.example/"), F.col("account_id").cast("string")))
        .alias("profile_pic_url"),
        F.col("page_url").alias("external_url"), F.col("c_mktsegment").alias("category_name"),
        F.col("bio").isNull().alias("is_private"), (F.col("verified") == 1).alias("is_verified"),
        F.struct(F.col("followers").cast("long").alias("count")).alias("edge_followed_by"),
        F.struct(F.col("following").cast("long").alias("count")).alias("edge_follow"),
        F.struct(F.col("posts").cast("long").alias("count")).alias("edge_owner_to_timeline_media"))
    return j.select("account_id", F.to_json(F.struct(F.struct(user.alias("user")).alias("data"))).alias("payload"))


PAYLOAD_SQL = """pl AS (SELECT a.account_id, a.username, c.c_mktsegment AS full_name, coalesce(a.bio, '') AS biography,
    CAST(a.followers AS BIGINT) AS follower_count, CAST(a.following AS BIGINT) AS following_count,
    coalesce(CAST(a.posts AS BIGINT), 0) AS post_count, a.bio IS NULL AS is_private, a.verified = 1 AS is_verified,
    a.has_profile_pic = 1 AS has_profile_pic,
    CASE WHEN a.has_profile_pic = 1 THEN 'https://img.example/' || CAST(a.account_id AS VARCHAR) ELSE '' END
      AS profile_pic_url,
    coalesce(pg.url, '') AS external_url, c.c_mktsegment AS business_category, a.bio IS NULL AS is_partial,
    CASE WHEN a.bio IS NULL THEN 'username,full_name,biography,follower_count,following_count,post_count,is_verified,has_profile_pic,external_url'
         ELSE 'username,full_name,biography,follower_count,following_count,post_count,is_verified,has_profile_pic,external_url,business_category' END
      AS available_fields
  FROM accounts a JOIN customer c ON c.c_custkey = a.account_id LEFT JOIN pages pg ON pg.page_id = a.account_id)"""


def _flat(spark, sf_dir):
    return PR.flatten_web_payload(_payloads(spark, sf_dir), "payload")


@query("s13_web_payload", with_accounts("""SELECT account_id, username, full_name, biography, follower_count,
    following_count, post_count, is_private, is_verified, has_profile_pic, profile_pic_url, external_url,
    business_category, is_partial, available_fields,
    CASE WHEN is_partial THEN 'Private profile — prediction uses partial data: ' || replace(available_fields, ',', ', ')
    END AS warning FROM pl""", PAYLOAD_SQL))
def s13_web_payload(spark, sf_dir):
    f = _flat(spark, sf_dir)
    return f.select("account_id", *[c for c in PR.PROFILE_COLUMNS if c != "available_fields"],
                    F.array_join("available_fields", ",").alias("available_fields"),
                    PR.private_warning(f).alias("warning"))


def _supplier_records(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"))
    n = t.nation.select("n_nationkey", "n_name")
    sup = t.supplier
    s = sup.join(li, sup.s_suppkey == li.l_suppkey, "left").join(n, sup.s_nationkey == n.n_nationkey, "left")
    return s.select(F.concat(F.lit("user_"), F.col("s_suppkey").cast("string")).alias("username"),
                    F.col("s_name").alias("full_name"), F.lit(None).cast("string").alias("biography"),
                    F.greatest(F.floor("s_acctbal"), F.lit(0)).alias("followers"), F.lit(0).alias("followees"),
                    F.coalesce("n_lines", F.lit(0)).alias("mediacount"), (F.col("s_acctbal") < 0).alias("is_private"),
                    F.lit(False).alias("is_verified"), F.lit(None).cast("string").alias("profile_pic_url"),
                    F.lit(None).cast("string").alias("external_url"), F.col("n_name").alias("business_category_name"))


_SUPP_SQL = """sr AS (SELECT 'user_' || CAST(s_suppkey AS VARCHAR) AS username, s_name AS full_name, '' AS biography,
    CAST(greatest(floor(s_acctbal), 0) AS BIGINT) AS follower_count, CAST(0 AS BIGINT) AS following_count,
    coalesce(li.n_lines, 0) AS post_count, s_acctbal < 0 AS is_private, FALSE AS is_verified, FALSE AS has_profile_pic,
    '' AS profile_pic_url, '' AS external_url, CASE WHEN s_acctbal < 0 THEN '' ELSE coalesce(n_name, '') END
      AS business_category, s_acctbal < 0 AS is_partial
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines FROM lineitem GROUP BY 1) li ON li.l_suppkey = s_suppkey
  LEFT JOIN nation ON n_nationkey = s_nationkey)"""


@query("s14_loader_record", f"WITH {_SUPP_SQL} SELECT * FROM sr")
def s14_loader_record(spark, sf_dir):
    return PR.loader_record(_supplier_records(spark, sf_dir)).drop("available_fields")


@query("s15_two_source_fallback", with_accounts(
    """SELECT username, src FROM (SELECT 'user_' || CAST(account_id AS VARCHAR) AS username, 'web' AS src FROM pl
         WHERE NOT is_private) p
       UNION ALL SELECT username, 'loader' FROM sr WHERE username NOT IN
         (SELECT 'user_' || CAST(account_id AS VARCHAR) FROM pl WHERE NOT is_private)""", PAYLOAD_SQL, _SUPP_SQL))
def s15_two_source_fallback(spark, sf_dir):
    prim = _flat(spark, sf_dir).where(~F.col("is_private")) \
        .select(F.concat(F.lit("user_"), F.col("account_id").cast("string")).alias("username"),
                F.lit("web").alias("src"))
    sec = PR.loader_record(_supplier_records(spark, sf_dir)).select("username", F.lit("loader").alias("src"))
    return PR.two_source_fallback(prim, sec)


@query("s16_prediction_row", with_accounts("""SELECT account_id, followers, following, posts, verified, has_profile_pic,
    has_external_url, suspicious_links_in_bio, account_age_days, round(posts / greatest(account_age_days, 1), 6)
      AS posts_per_day, business_category FROM (
  SELECT account_id, follower_count AS followers, following_count AS following, post_count AS posts,
    CAST(is_verified AS INTEGER) AS verified, CAST(has_profile_pic AS INTEGER) AS has_profile_pic,
    CAST(external_url <> '' AS INTEGER) AS has_external_url,
    CAST(regexp_matches(biography, '(?i)http[s]?://|www\\.') AS INTEGER) AS suspicious_links_in_bio,
    CAST(greatest(365, least(greatest(post_count * 7, follower_count * 2, following_count * 2), 2693)) AS BIGINT)
      AS account_age_days,
    CASE WHEN business_category = '' THEN 'unknown' ELSE business_category END AS business_category FROM pl)""",
    PAYLOAD_SQL))
def s16_prediction_row(spark, sf_dir):
    pr = PR.prediction_row(_flat(spark, sf_dir))
    return round_doubles(pr.select("account_id", "followers", "following", "posts", "verified", "has_profile_pic",
                                   "has_external_url", "suspicious_links_in_bio",
                                   F.col("account_age_days").cast("long").alias("account_age_days"),
                                   "posts_per_day", "business_category"))


def _form_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = acc(spark, sf_dir)
    pg = t.pages.select(F.col("page_id").alias("account_id"), F.col("url").alias("website"))
    return a.join(pg, "account_id", "left").select(
        "account_id", "username", F.col("bio").alias("biography"), "website", "followers", "following",
        F.coalesce("posts", F.lit(0.0)).alias("posts"), (F.col("has_profile_pic") == 1).alias("has_profile_pic"),
        (F.col("verified") == 1).alias("verified"))


@query("s17_manual_form", with_accounts("""SELECT a.account_id, a.username, coalesce(a.bio, '') AS bio,
    has_profile_pic, CAST(length(coalesce(a.bio, '')) AS BIGINT) AS bio_length,
    CAST(followers AS BIGINT) AS followers, CAST(following AS BIGINT) AS following,
    round(CAST(followers AS BIGINT) / greatest(CAST(following AS BIGINT), 1), 6) AS follower_following_ratio,
    CAST(greatest(365, least(greatest(CAST(coalesce(posts, 0) AS BIGINT) * 7, CAST(followers AS BIGINT) * 2,
         CAST(following AS BIGINT) * 2), 2693)) AS BIGINT) AS account_age_days,
    CAST(coalesce(posts, 0) AS BIGINT) AS posts,
    CAST(coalesce(pg.url, '') <> '' OR contains(lower(coalesce(a.bio, '')), 'http')
         OR contains(lower(coalesce(a.bio, '')), 'bit.ly') AS INTEGER) AS suspicious_links_in_bio, verified
  FROM accounts a LEFT JOIN pages pg ON pg.page_id = a.account_id"""))
def s17_manual_form(spark, sf_dir):
    r = PR.manual_form_row(_form_rows(spark, sf_dir))
    return round_doubles(r.select("account_id", "username", "bio", "has_profile_pic",
                                  F.col("bio_length").cast("long").alias("bio_length"), "followers", "following",
                                  "follower_following_ratio", F.col("account_age_days").cast("long")
                                  .alias("account_age_days"), "posts", "suspicious_links_in_bio", "verified"))


from ..operators.clean import WS_CLASS as _WSC  # noqa: E402
_WS = _WSC.replace("\\\\", "\\")


@query("s18_username_list", "SELECT doc_id, u AS username FROM (SELECT doc_id, unnest(list_filter(list_transform("
       "string_split(text, ','), lambda x: regexp_replace(regexp_replace(x, '^" + _WS + "+|" + _WS + "+$', '', 'g'), "
       "'^@+', '')), lambda x: x <> '')) AS u FROM documents)")
def s18_username_list(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", F.explode(PR.username_list(F.col("text"))).alias("username"))


@query("s19_demo_rows", with_accounts("""SELECT account_id,
    CASE WHEN length(username) = 0 OR (length(username) - length(regexp_replace(username, '[0-9]', '', 'g')))
              / greatest(length(username), 1) > 0.45 THEN 0 ELSE 1 END AS has_profile_pic,
    CAST((length(username) - length(regexp_replace(username, '[0-9]', '', 'g'))) / greatest(length(username), 1) > 0.35
         AS INTEGER) AS username_randomness,
    CASE WHEN coalesce(label, 0) = 0 THEN least(followers, 21000) ELSE followers END AS followers,
    CASE WHEN coalesce(label, 0) = 0 THEN greatest(least(following, 2281), 100) ELSE following END AS following,
    CASE WHEN coalesce(label, 0) = 0 THEN greatest(posts, 660) ELSE posts END AS posts,
    CAST(contains(lower(coalesce(bio, '')), 'http') OR contains(lower(coalesce(bio, '')), 'bit.ly') AS INTEGER)
      AS suspicious_links_in_bio
  FROM accounts"""))
def s19_demo_rows(spark, sf_dir):
    a = acc(spark, sf_dir).select("account_id", "username", F.col("bio").alias("biography"),
                                  F.col("followers").alias("followers_count"), F.col("following").alias("follows_count"),
                                  F.col("posts").alias("media_count"), (F.col("verified") == 1).alias("is_verified"),
                                  F.col("label").alias("is_fake"))
    d = PR.demo_rows(a)
    return d.select("account_id", "has_profile_pic", "username_randomness", "followers", "following", "posts",
                    "suspicious_links_in_bio")


def _multiclass_raw(spark, sf_dir):
    p = _path(spark, "multiclass")
    _multiclass(spark, sf_dir).write.mode("overwrite").option("header", True).option("escape", '"').csv(p)
    return RD.read_csv_strings(spark, p)


@query("p02_yes_no_flag", with_accounts("SELECT account_id, CAST(has_profile_pic = 1 AS INTEGER) AS picture, "
                                        "CAST(verified = 1 AS INTEGER) AS link FROM accounts"))
def p02_yes_no_flag(spark, sf_dir):
    from ..operators.clean import yes_no_flag
    r = _multiclass_raw(spark, sf_dir)
    return r.select(F.col("account_id").cast("long").alias("account_id"),
                    yes_no_flag(F.col("Profile Picture")).alias("picture"),
                    yes_no_flag(F.col("External Link")).alias("link"))


@query("p03_class_label", with_accounts("SELECT account_id, CASE WHEN label = 0 THEN 0 ELSE 1 END AS label FROM accounts"))
def p03_class_label(spark, sf_dir):
    from ..operators.clean import class_to_label
    r = _multiclass_raw(spark, sf_dir)
    return r.select(F.col("account_id").cast("long").alias("account_id"), class_to_label(F.col("Labels")).alias("label"))


@query("p04_presence_length", with_accounts("SELECT account_id, CASE WHEN bio IS NULL THEN 0 ELSE 80 END AS bio_length "
                                            "FROM accounts"))
def p04_presence_length(spark, sf_dir):
    from ..operators.clean import presence_length
    r = _multiclass_raw(spark, sf_dir)
    return r.select(F.col("account_id").cast("long").alias("account_id"), presence_length(F.col("Bio")).alias("bio_length"))
