"""Queries for the profile roll-ups and derivations."""

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.clean import WS_CLASS
from ..sources.tables import Tables
from .common import acc, round_doubles, with_accounts
from .registry import query

_WS = WS_CLASS.replace("\\\\", "\\")
_KW = " OR ".join(f"contains(lower(coalesce(text, '')), '{k}')" for k in P.CAPTION_SPAM_KEYWORDS)

C01_SQL = f"""w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '{_WS}+'),
                 lambda x: x <> '')) AS ws FROM conversations WHERE text IS NOT NULL AND text <> ''),
cm AS (SELECT conv_id, count(*) AS m FROM conversations GROUP BY conv_id),
cp AS (SELECT a.conv_id, len(list_intersect(a.ws, b.ws)) / greatest(len(list_distinct(list_concat(a.ws, b.ws))), 1) AS j
       FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn),
c01 AS (SELECT cm.conv_id, CASE WHEN cm.m < 2 OR count(cp.j) = 0 THEN 0.0 ELSE avg(cp.j) END AS caption_similarity_score
        FROM cm LEFT JOIN cp ON cp.conv_id = cm.conv_id GROUP BY cm.conv_id, cm.m),
c02 AS (SELECT conv_id, avg(CAST(({_KW}) AS DOUBLE)) AS spam_comments_rate FROM conversations GROUP BY conv_id)"""


def _c01(spark, sf_dir):
    return P.caption_similarity(Tables(spark, sf_dir).conversations, "conv_id", "turn", "text")


def _c02(spark, sf_dir):
    return P.spam_rate(Tables(spark, sf_dir).conversations, "conv_id", "text")


@query("c01_caption_similarity", f"WITH {C01_SQL} SELECT conv_id, round(caption_similarity_score, 6) AS "
                                 "caption_similarity_score FROM c01")
def c01_caption_similarity(spark, sf_dir):
    return round_doubles(_c01(spark, sf_dir))


@query("c02_spam_rate", f"WITH {C01_SQL} SELECT conv_id, round(spam_comments_rate, 6) AS spam_comments_rate FROM c02")
def c02_spam_rate(spark, sf_dir):
    return round_doubles(_c02(spark, sf_dir))


@query("c03_age_from_oldest", """SELECT user_id, CAST(greatest(1, floor(date_diff('microsecond', min(ts),
    (SELECT max(ts) FROM events)) / 86400000000)) AS BIGINT) AS account_age_days FROM events GROUP BY user_id""")
def c03_age_from_oldest(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    as_of = ev.select(F.max("ts")).scalar()
    return P.age_from_oldest(ev, "user_id", "ts", as_of)


@query("c04_engagement", """SELECT user_id, round(sum(coalesce(value, 0)), 6) AS total_likes,
    CAST(sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS total_comments,
    count(*) AS n_posts, round(sum(coalesce(value, 0)) / greatest(count(*), 1), 6) AS likes_per_post
  FROM events GROUP BY user_id""")
def c04_engagement(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.withColumn("comments", F.get_json_object("props", "$.k").cast("long"))
    return round_doubles(P.engagement(ev, "user_id", "value", "comments"))


@query("c05_proxies", f"""WITH {C01_SQL}
SELECT c.c_custkey AS account_id, round(coalesce(c01.caption_similarity_score, 0) * 0.8, 6) AS content_similarity_score,
       round(coalesce(c02.spam_comments_rate, 0) * 0.5, 6) AS generic_comment_rate,
       CAST((length(c.c_name) - length(regexp_replace(c.c_name, '[0-9]', '', 'g'))) / greatest(length(c.c_name), 1) > 0.4
            AS INTEGER) AS username_randomness,
       CAST(contains(lower(coalesce(d.text, '')), 'http') OR contains(lower(coalesce(d.text, '')), 'bit.ly') AS INTEGER)
            AS suspicious_links_in_bio
FROM customer c LEFT JOIN c01 ON c01.conv_id = c.c_custkey LEFT JOIN c02 ON c02.conv_id = c.c_custkey
LEFT JOIN documents d ON d.doc_id = c.c_custkey""")
def c05_proxies(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.customer.select(F.col("c_custkey").alias("account_id"), "c_name")
    d = t.documents.select(F.col("doc_id").alias("account_id"), "text")
    j = c.join(_c01(spark, sf_dir).withColumnRenamed("conv_id", "account_id"), "account_id", "left") \
         .join(_c02(spark, sf_dir).withColumnRenamed("conv_id", "account_id"), "account_id", "left") \
         .join(d, "account_id", "left")
    px = P.proxies(F.coalesce("caption_similarity_score", F.lit(0.0)), F.coalesce("spam_comments_rate", F.lit(0.0)),
                   F.col("c_name"), F.col("text"))
    return round_doubles(j.select("account_id", *[v.alias(k) for k, v in px.items()]))


PROFILE_SQL = """prof AS (SELECT a.account_id, a.username, n.n_name || ' ' || c.c_mktsegment AS full_name,
         a.bio AS biography, a.followers AS follower_count, a.following AS following_count, pg.url AS external_url
  FROM accounts a JOIN customer c ON c.c_custkey = a.account_id JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN pages pg ON pg.page_id = a.account_id)"""


def profiles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = acc(spark, sf_dir)
    c = t.customer.select(F.col("c_custkey").alias("account_id"), "c_nationkey", "c_mktsegment")
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    pg = t.pages.select(F.col("page_id").alias("account_id"), F.col("url").alias("external_url"))
    return a.join(c, "account_id").join(n, "c_nationkey").join(pg, "account_id", "left").select(
        "account_id", "username", F.concat_ws(" ", "n_name", "c_mktsegment").alias("full_name"),
        F.col("bio").alias("biography"), F.col("followers").alias("follower_count"),
        F.col("following").alias("following_count"), "external_url")


@query("c06_profile_derivations", with_accounts(f"""SELECT account_id, length(username) AS username_length,
    length(full_name) AS fullname_length, length(coalesce(biography, '')) AS bio_length,
    coalesce(external_url, '') <> '' AS has_external_url,
    round(follower_count / greatest(following_count, 1), 6) AS follower_following_ratio,
    regexp_matches(username, '[0-9]') AS username_has_numbers,
    regexp_matches(username, '[^a-zA-Z0-9._]') AS username_has_special_chars,
    CAST(len(list_filter(string_split_regex(full_name, '{_WS}+'), lambda x: x <> '')) AS BIGINT) AS fullname_word_count,
    regexp_matches(coalesce(biography, ''), '(?i)http[s]?://|www\\.') AS bio_has_url,
    regexp_matches(coalesce(biography, ''), '\\+?[0-9][0-9\\s\\-]{{7,}}[0-9]') AS bio_has_phone,
    regexp_matches(coalesce(biography, ''), '[^\\x00-\\x7F]') AS bio_has_emoji,
    length(username) - length(regexp_replace(username, '[0-9]', '', 'g')) AS digits_in_username,
    round((length(username) - length(regexp_replace(username, '[0-9]', '', 'g'))) / greatest(length(username), 1), 6)
      AS username_digit_ratio
  FROM prof""", PROFILE_SQL))
def c06_profile_derivations(spark, sf_dir):
    d = P.profile_derivations(profiles(spark, sf_dir))
    return round_doubles(d.drop("username", "full_name", "biography", "follower_count", "following_count",
                                "external_url"))
