"""Exact top-k inner products by columnar branch-and-bound.

Queries and candidates are dealt into blocks of bounded size, and each pair of
blocks is one group.  In a group the candidates lie in vertical layout (one row
per dimension); a query adds up its products dimension block by dimension
block.  After each block the Cauchy-Schwarz bound on the remaining mass gives
every candidate a lowest and a highest possible score; those that cannot reach
the k-th best lowest score are compacted away.  The survivors of all groups meet
in a rank per query: at most k rows per query and candidate block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table

K = 5
SCALE = 256
QUERY_ROWS, CANDIDATE_ROWS, DIMENSIONS = 2048, 8192, 16
_EXACT = 2 ** 53


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def block_top(queries: np.ndarray, own: np.ndarray, cands: np.ndarray, uids: np.ndarray, ids: np.ndarray,
              k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: places and scores of its k best candidates but itself, ties to smaller ids."""
    d = cands.shape[1]
    # float64 holds the sums exactly below 2^53; beyond, 64-bit integers and no bounds
    mass = np.abs(queries.astype(float)).max(initial=0) * np.abs(cands.astype(float)).max(initial=0) * d
    exact = mass < _EXACT
    order = np.argsort(-np.square(cands.astype(float)).sum(0), kind="stable")
    x = np.ascontiguousarray(cands[:, order].T, np.float64 if exact else np.int64)
    q = queries[:, order].astype(x.dtype)
    steps = [slice(a, min(a + DIMENSIONS, d)) for a in range(0, d, DIMENSIONS)]
    rest = [np.sqrt(np.square(x[s.stop:].astype(float)).sum(0)) for s in steps]
    left = [np.sqrt(np.square(q[:, s.stop:].astype(float)).sum(1)) for s in steps]
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero(uids != own[i])
        acc = np.zeros(len(alive), x.dtype)
        for s, r, m in zip(steps, rest, left):
            acc = acc + (q[i, s] @ (x[s] if len(alive) == x.shape[1] else x[s][:, alive]))
            if exact and len(alive) > k and s.stop < d:
                slack = m[i] * r[alive] * (1 + 1e-9) + 0.5
                floor = np.partition(acc - slack, len(alive) - k)[len(alive) - k]
                stay = acc + slack >= floor
                alive, acc = alive[stay], acc[stay]
        best = np.lexsort((ids[alive], -acc))[:k]
        out.append((alive[best], acc[best].astype(np.int64)))
    return out


def top_k(vectors: DataFrame, is_query: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """(query_id, rank, id_col, score) of each query row's k highest inner products.

    Defined results: vectors that are null or hold null or non-finite components
    and rows without an id take no part; components beyond 64-bit integers are
    held at their ends; vectors of other lengths are compared as if zeros
    followed; a repeated id is a row of its own, as query and as candidate;
    equal scores go to the smaller id; fewer than k candidates give fewer rows;
    an empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    infinite = float("inf")
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"), F.expr(is_query)
                          .alias("query")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != infinite)))
    rows = cut_lineage(rows.select("id", "query", F.transform("v", lambda c: F.floor(c * SCALE)).alias("v"))
                       .withColumn("uid", F.monotonically_increasing_id()))
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("query"), 1)).alias("queries")).first()
    qs, cs = math.ceil(n["queries"] / query_rows) or 1, math.ceil(n["rows"] / candidate_rows) or 1
    at = F.pmod(F.xxhash64("uid"), F.lit(cs)).cast("int")
    cands = rows.select("id", "uid", "v", at.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(qs - 1))).alias("q"))
    asked = rows.filter("query").select("id", "uid", "v", F.pmod(F.xxhash64("uid"), F.lit(qs)).cast("int").alias("q"),
                                        F.explode(F.sequence(F.lit(0), F.lit(cs - 1))).alias("c"))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_uid": [], "query_id": [], "id": [], "score": []})
        width = max(1, max(map(len, a["v"])), max(map(len, b["v"])))
        ids, uids = b["id"].to_numpy(), b["uid"].to_numpy()
        got = block_top(padded(a["v"], width), a["uid"].to_numpy(), padded(b["v"], width), uids, ids, k)
        size = [len(p) for p, _ in got]
        return pd.DataFrame({"query_uid": np.repeat(a["uid"].to_numpy(), size), "query_id": np.repeat(a["id"].to_numpy(), size),
                             "id": ids[np.concatenate([p for p, _ in got])], "score": np.concatenate([s for _, s in got])})

    best = asked.groupBy("q", "c").cogroup(cands.groupBy("q", "c")).applyInPandas(
        run, "query_uid long, query_id long, id long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 50 = 0")


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
