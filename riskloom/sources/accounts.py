"""The `accounts` mapping: one row per customer built from the driver tables.

All joins are left joins on the customer key and every joined side is first
aggregated to one row per key, so no join can fan out or skew: a customer that
owns a third of all orders is one partial-aggregated row before it meets the
customer table.  Lineitem is pre-aggregated per order (map-side combine) before
it meets orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables


def order_rollup(t: Tables) -> DataFrame:
    qty = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return (orders.join(qty, orders.o_orderkey == qty.l_orderkey, "left")
            .groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("n_orders"),
                 F.sum("q").alias("qty"),
                 F.min("o_orderdate").alias("first_order")))


def event_rollup(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", "value")
    return e.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("n_error"),
        F.count_if(F.col("event_type") == "click").alias("n_click"),
        F.count_if(F.col("event_type") == "view").alias("n_view"),
        F.avg("value").alias("avg_value"))


def accounts(t: Tables) -> DataFrame:
    as_of = t.orders.select(F.max("o_orderdate")).scalar()   # scalar subquery, no collect
    cust = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    o = order_rollup(t)
    e = event_rollup(t)
    d = t.documents.select("doc_id", "text", "n_chars")
    lab = t.labels.select(F.col("doc_id").alias("l_doc_id"), "quality", "toxic")
    j = (cust.join(o, cust.c_custkey == o.o_custkey, "left")
         .join(e, cust.c_custkey == e.user_id, "left")
         .join(d, cust.c_custkey == d.doc_id, "left")
         .join(lab, cust.c_custkey == lab.l_doc_id, "left"))
    return j.select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("username"),
        F.col("text").alias("bio"),
        F.col("n_chars").cast("double").alias("bio_length"),
        F.when(F.col("c_acctbal") < 0, F.lit(0.0))
         .otherwise(F.floor("c_acctbal").cast("double")).alias("followers"),
        F.coalesce(F.col("qty"), F.lit(0.0)).cast("double").alias("following"),
        F.col("n_orders").cast("double").alias("posts"),
        F.datediff(as_of, F.col("first_order")).cast("double").alias("account_age_days"),
        (F.col("c_mktsegment") == "MACHINERY").cast("int").alias("verified"),
        (F.col("c_acctbal") >= 0).cast("int").alias("has_profile_pic"),
        F.col("n_error").alias("follow_unfollow_rate"),
        F.col("n_click").alias("spam_comments_rate"),
        F.col("n_view").alias("generic_comment_rate"),
        (F.col("avg_value") / 100).alias("caption_similarity_score"),
        F.when(F.col("l_doc_id").isNull(), F.lit(None).cast("int"))
         .when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(1))
         .otherwise(F.lit(0)).alias("label"),
    )


# DuckDB form of the same mapping, used as a CTE by every oracle over accounts.
ACCOUNTS_SQL = """
accounts AS (
  SELECT c.c_custkey AS account_id,
         c.c_name AS username,
         d.text AS bio,
         CAST(d.n_chars AS DOUBLE) AS bio_length,
         CAST(CASE WHEN c.c_acctbal < 0 THEN 0 ELSE floor(c.c_acctbal) END AS DOUBLE) AS followers,
         CAST(coalesce(o.qty, 0) AS DOUBLE) AS following,
         CAST(o.n_orders AS DOUBLE) AS posts,
         CAST(date_diff('day', o.first_order, (SELECT max(o_orderdate) FROM orders)) AS DOUBLE) AS account_age_days,
         CAST(c.c_mktsegment = 'MACHINERY' AS INTEGER) AS verified,
         CAST(c.c_acctbal >= 0 AS INTEGER) AS has_profile_pic,
         e.n_error AS follow_unfollow_rate,
         e.n_click AS spam_comments_rate,
         e.n_view AS generic_comment_rate,
         e.avg_value / 100 AS caption_similarity_score,
         CASE WHEN lb.doc_id IS NULL THEN NULL
              WHEN lb.quality = 0 OR lb.toxic = 1 THEN 1 ELSE 0 END AS label
  FROM customer c
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(q) AS qty, min(o_orderdate) AS first_order
             FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) li
                  ON orders.o_orderkey = li.l_orderkey
             GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT user_id,
                    count(*) FILTER (WHERE event_type = 'error') AS n_error,
                    count(*) FILTER (WHERE event_type = 'click') AS n_click,
                    count(*) FILTER (WHERE event_type = 'view') AS n_view,
                    avg(value) AS avg_value
             FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey
  LEFT JOIN documents d ON d.doc_id = c.c_custkey
  LEFT JOIN labels lb ON lb.doc_id = c.c_custkey
)"""
