"""What learners and the text SVD hand to Spark."""

import unicodedata

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import clean as C
from riskloom.operators import models as M
from riskloom.operators import text as TX


def test_svd_reads_a_checkpointed_table_and_embeds_by_its_rank(spark, monkeypatch):
    import pyspark.mllib.linalg.distributed as D
    from pyspark.sql import DataFrame
    rng = np.random.default_rng(5)
    X = rng.random((12, 6)) * (rng.random((12, 6)) < 0.6) + np.eye(12, 6)
    rows = [(i, f"t{j}", float(X[i, j])) for i in range(12) for j in range(6) if X[i, j]]
    w = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    seen, real = [], D.IndexedRowMatrix
    monkeypatch.setattr(D, "IndexedRowMatrix", lambda rows, *a: (seen.append(rows), real(rows, *a))[1])
    got = {r.doc_id: r.embedding for r in TX.svd_embed(w, dim=4).collect()}
    assert isinstance(seen[0], DataFrame)
    docs = sorted({r[0] for r in rows})
    X = X[docs]
    u, s, _ = np.linalg.svd(X, full_matrices=False)
    E, want = np.array([got[i] for i in docs]), (u * s)[:, :4]
    assert np.allclose(E @ E.T, want @ want.T, atol=1e-6)


def test_long_texts_reach_python_in_batches_of_bounded_bytes(spark):
    def rows(batches):
        import pandas as pd
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})
    texts = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("é"), 20_000).alias("t"))   # 40 KB each
    assert max(r.n for r in texts.mapInPandas(rows, "n long").collect()) < 500


def test_nfkc_folds_wide_texts_and_leaves_ascii_out_of_python(spark, monkeypatch):
    from riskloom.functions import udfs
    texts = ["plain", "", None, "ﬁn ①", "é", "Ａb", "a\nb"]
    x = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.t for r in x.select("i", C.nfkc(F.col("t")).alias("t")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    monkeypatch.setattr(udfs, "nfkc", lambda c: c)               # what the Python side is given
    sent = C.nfkc(F.col("t"))._jc.toString()
    assert "RLIKE" in sent.upper() and "WHEN" in sent.upper()


def test_feature_map_sends_only_the_vector_to_python(spark):
    W, b = np.array([[1.0, 2.0], [0.5, -1.0], [0.0, 3.0]]), np.array([0.1, 0.2, 0.3])
    x = spark.createDataFrame([(1, "a text", [1.0, 2.0]), (2, None, [0.0, -1.0])], "id int, bio string, v array<double>")
    out = M._rff(x.withColumn("features", array_to_vector("v")), W, b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    for r in out.collect():
        assert np.allclose(r.rff.toArray(), np.sqrt(2 / 3) * np.cos(W @ np.array(r.v) + b))
        assert r.bio == {1: "a text", 2: None}[r.id] and r.features.toArray().tolist() == r.v


def test_tfidf_counts_tokens_once_and_shuffles_texts_not_tokens(spark, monkeypatch):
    rows = [(1, "red red blue"), (1, "red green"), (2, "blue green"), (3, "  \n"), (4, None), (None, "red blue"), (5, "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, real = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: (kept.append(df), real(df))[1])
    got = {(r.doc_id, r.term): r.weight for r in TX.tfidf(docs, max_features=3).collect()}
    assert len(kept) == 1 and kept[0].columns == ["doc", "term", "tf"]
    assert kept[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2   # initial and final plan
    tf = {1: {"red": 3, "blue": 1, "green": 1}, 2: {"blue": 1, "green": 1}, None: {"red": 1, "blue": 1}}
    n = 5                                                        # texts that are not blank, "?" among them
    df = {t: sum(t in c for c in tf.values()) for t in ("red", "blue", "green")}
    want = {}
    for doc in (1, 2):
        w = {t: (1 + np.log(k)) * (np.log((1 + n) / (1 + df[t])) + 1) for t, k in tf[doc].items()}
        norm = np.sqrt(sum(v * v for v in w.values()))
        want |= {(doc, t): v / norm for t, v in w.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_deep_forests_keep_node_numbers_by_row_and_give_the_same_trees(spark):
    """Without them every job of a level carries the whole forest grown so far."""
    x = (spark.range(400, numPartitions=3)
         .select(F.array(F.rand(1), F.rand(2), F.rand(3)).alias("x"), (F.rand(4) > 0.5).cast("double").alias("label"))
         .select(array_to_vector("x").alias("features"), "label").cache())
    zoo = M.model_zoo(3, trees=2)
    for name in ("random_forest", "extra_trees"):
        assert zoo[name].getCacheNodeIds()
        plain = zoo[name].copy({zoo[name].cacheNodeIds: False})
        assert zoo[name].fit(x).toDebugString.split("\n")[1:] == plain.fit(x).toDebugString.split("\n")[1:]
