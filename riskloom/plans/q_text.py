"""Queries for text vectors."""

from pyspark.sql import functions as F

from ..operators import text as TX
from ..operators.clean import WS_CLASS
from ..sources.tables import Tables
from .common import acc, round_doubles, with_accounts
from .registry import query

_WS = WS_CLASS


@query("v01_tfidf", f"""WITH docs AS (SELECT doc_id, text FROM documents
      WHERE text IS NOT NULL AND regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') <> ''),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1.0 AS idf FROM st
          ORDER BY cf DESC, term LIMIT 5000),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT doc_id, term, round(w / norm, 6) AS weight FROM w JOIN nrm USING (doc_id)""")
def v01_tfidf(spark, sf_dir):
    return round_doubles(TX.tfidf(Tables(spark, sf_dir).documents, max_features=TX.MAX_FEATURES))


@query("v03_zero_vectors", "SELECT doc_id, len(list_filter(emb, lambda x: x <> 0)) AS nonzero FROM "
                           "(SELECT doc_id, list_transform(range(64), lambda i: 0.0) AS emb FROM documents "
                           "WHERE NOT EXISTS (SELECT 1 FROM documents d2 WHERE d2.lang = 'none'))")
def v03_zero_vectors(spark, sf_dir):
    """The corpus restricted to a language that does not occur (< 2 texts) embeds to zeros."""
    d = Tables(spark, sf_dir).documents
    empty = d.where(F.col("lang") == "none")
    out = TX.embed_or_zero(d.select("doc_id"), "doc_id", empty)
    return out.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("nonzero"))


@query("v04_join_embeddings", with_accounts(
    "SELECT a.account_id, CAST(e.vec_id IS NOT NULL AS INTEGER) AS has_embedding, "
    "round(coalesce(list_sum(CAST(e.embedding AS DOUBLE[])), 0.0), 4) AS emb_sum "
    "FROM accounts a LEFT JOIN embeddings e ON e.vec_id = a.account_id"))
def v04_join_embeddings(spark, sf_dir):
    a = acc(spark, sf_dir).select("account_id")
    j = TX.join_embeddings(a, "account_id", Tables(spark, sf_dir).embeddings)
    emb_sum = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    e_ids = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("account_id"), F.lit(1).alias("has_embedding"))
    return j.join(e_ids, "account_id", "left").select(
        "account_id", F.coalesce("has_embedding", F.lit(0)).alias("has_embedding"), F.round(emb_sum, 4).alias("emb_sum"))


@query("v02_svd_embedding")
def v02_svd_embedding(spark, sf_dir):
    from ..session import cut_lineage
    w = cut_lineage(TX.tfidf(Tables(spark, sf_dir).documents, max_features=TX.MAX_FEATURES))
    return TX.svd_embed(w)
