"""Text vectors.

TF-IDF is computed in long form (doc, term, weight): tokens are exploded,
term counts per (doc, term) and document frequencies per term are partial
aggregates (a term that appears in every document is one pre-aggregated row
per task before the shuffle), the 5000-term vocabulary is a bounded top-k,
and the L2 norm is one aggregate per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import WS_CLASS, strip_ws

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"      # runs of >= 2 word characters (Unicode letters, digits, _)
MAX_FEATURES = 5000
DIM = 64


def tokens(text_col: str):
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)


def has_text(c):
    """Not null and not only white space: one other code point is enough, where stripping reads the whole text."""
    return c.isNotNull() & c.rlike(WS_CLASS.replace("[", "[^", 1))


def tfidf(docs: DataFrame, key: str = "doc_id", text_col: str = "text", max_features: int | None = None) -> DataFrame:
    """Sublinear tf (1 + ln tf), smooth idf ln((1+n)/(1+df)) + 1, rows
    L2-normalised.  The vocabulary is every term, or the max_features most
    frequent ones (ties by term) if the caller asks for a cut.
    Only non-blank texts take part."""
    from ..session import cut_lineage
    texts = docs.where(has_text(F.col(text_col)))
    n = texts.agg(F.count(F.lit(1))).first()[0]
    # texts meet by document, so that their tokens are counted without a shuffle of their own, and once for all uses
    d = texts.select(F.col(key).alias("doc"), F.col(text_col).alias("text")).repartition("doc") \
             .select("doc", F.explode(tokens("text")).alias("term"))
    tf = cut_lineage(d.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    if max_features is not None:
        stats = stats.orderBy(F.col("cf").desc(), F.col("term")).limit(max_features)
    vocab = stats.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    if max_features is not None and max_features <= MAX_FEATURES:
        vocab = F.broadcast(vocab)
    w = tf.join(vocab, "term").select("doc", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc").select(F.col("doc").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight"))


def zero_vector(dim: int = DIM):
    """The zero embedding used when the corpus is empty."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def embed_or_zero(df: DataFrame, key: str, docs: DataFrame, text_col: str = "text", dim: int = DIM) -> DataFrame:
    """V03 guard: fewer than 2 non-blank texts -> every row gets the zero vector."""
    n = docs.where(F.col(text_col).isNotNull() & (strip_ws(F.col(text_col)) != "")).agg(F.count(F.lit(1))).first()[0]
    if n < 2:
        return df.withColumn("embedding", zero_vector(dim))
    return df


def join_embeddings(df: DataFrame, key: str, emb: DataFrame, emb_key: str = "vec_id", emb_col: str = "embedding",
                    dim: int = DIM) -> DataFrame:
    """Join a precomputed embedding table on the key; rows without one get zeros."""
    e = emb.select(F.col(emb_key).alias(key), F.col(emb_col).alias("_emb"))
    return df.join(e, key, "left").withColumn("embedding", F.coalesce(F.col("_emb"), zero_vector(dim))).drop("_emb")


def svd_embed(weights: DataFrame, key: str = "doc_id", dim: int = DIM, seed: int = 42) -> DataFrame:
    """Truncated SVD of the TF-IDF matrix, n = min(64, vocab, docs - 1)
    components; document embedding = U * S (= X V).  The matrix is an
    IndexedRowMatrix of sparse rows (one row per document, width = vocabulary)
    and mllib's distributed eigen-solver works on Gramian-vector products.
    Component signs are arbitrary; rows pad to `dim` with zeros (V03)."""
    from pyspark.mllib.linalg import Vectors, VectorUDT
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    from pyspark.sql import Window
    from pyspark.sql.types import LongType, StructField, StructType
    spark = weights.sparkSession
    terms = weights.select("term").distinct()
    t_idx = terms.withColumn("j", F.row_number().over(Window.orderBy("term")) - 1)  # vocabulary <= 5000 rows
    vocab = t_idx.count()
    rows = weights.join(F.broadcast(t_idx), "term").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("j", "weight"))).alias("e"))         # <= vocabulary entries per doc
    n_docs = rows.count()
    k = min(dim, vocab, n_docs - 1)
    if k < 1:
        return rows.select(key, F.array_repeat(F.lit(0.0), dim).alias("embedding"))
    from ..session import cut_lineage

    # built once and kept as JVM rows: every Gramian-vector product reads them, none goes through Python again
    matrix = cut_lineage(spark.createDataFrame(
        rows.rdd.map(lambda r: (int(r[key]), Vectors.sparse(vocab, [x["j"] for x in r["e"]], [x["weight"] for x in r["e"]]))),
        StructType([StructField("index", LongType()), StructField("vector", VectorUDT())])))
    svd = IndexedRowMatrix(matrix).computeSVD(k, computeU=True)
    s = svd.s.toArray().tolist()
    u = cut_lineage(spark.createDataFrame(
        svd.U.rows.map(lambda r: (int(r.index), [float(v) for v in r.vector.toArray()])),
        f"{key} long, u array<double>"))
    emb = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: F.when(i < k, F.col("u")[i] * F.array(*[F.lit(x) for x in s])[i]).otherwise(0.0))
    return u.select(key, emb.alias("embedding"))
