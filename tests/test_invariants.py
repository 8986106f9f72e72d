"""Invariants for iterative, learned and sampled operators."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import graph as G
from riskloom.operators import neighbors as N
from riskloom.operators import sampling as S
from riskloom.operators.ordering import running_totals
from riskloom.plans.common import acc
from riskloom.sources.tables import Tables

from .conftest import SF_SMALL


def _emb(spark):
    e = Tables(spark, SF_SMALL).embeddings
    return e.select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("c"))


def test_pagerank_sums_to_one(spark):
    v, e = G.interaction_graph(acc(spark, SF_SMALL))
    pr = G.pagerank(v, e)
    assert abs(pr.agg(F.sum("pagerank")).first()[0] - 1.0) < 1e-6


def test_knn_blocked_equals_brute_force(spark):
    e = _emb(spark)
    got = N.knn_exact(e, e, 5, "vec_id", "vec_id", "embedding", exclude_self=True, block_rows=7)
    got = {(r.qid, r.rank): r.rid for r in got.collect()}
    rows = e.orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    X = np.array([r.embedding for r in rows], dtype=np.float64)
    for i, q in enumerate(ids):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((ids, np.round(d, 9)))[:5]
        for k, j in enumerate(order):
            assert got[(q, k + 1)] == ids[j]


def test_lsh_recall_against_exact(spark):
    e = _emb(spark)
    exact = N.knn_exact(e, e, 5, "vec_id", "vec_id", "embedding", exclude_self=True)
    lsh = N.knn_lsh(e, e, 5, "vec_id", "vec_id", "embedding", exclude_self=True, threshold=10.0, bucket_length=4.0)
    hit = exact.join(lsh.select("qid", "rid"), ["qid", "rid"]).count()
    assert hit / exact.count() >= 0.9


def test_running_totals_independent_of_partitioning(spark):
    df = spark.range(0, 500).select((F.col("id") % 7).alias("g"), F.col("id"), (F.col("id") % 3).alias("v"))
    a = {(r.g, r.id): r.cum_v for r in running_totals(df, ["id"], ["v"], "g", n_parts=1).collect()}
    b = {(r.g, r.id): r.cum_v for r in running_totals(df, ["id"], ["v"], "g", n_parts=8).collect()}
    assert a == b
    assert a[(0, 0)] == 0 and a[(0, 7)] == 0 and a[(0, 14)] == 1


def test_smote_points_between_seed_and_neighbour(spark):
    e = _emb(spark).where((F.col("c") == 1) | (F.col("vec_id") % 3 == 0))
    out = S.smote(e, "vec_id", "embedding", label="c", k=5)
    counts = {r.c: r["count"] for r in out.groupBy("c").count().collect()}
    assert counts[0] == counts[1]
    syn = out.where("synthetic").join(e.select(F.col("vec_id").alias("seed_key"), F.col("embedding").alias("s")),
                                      "seed_key") \
             .join(e.select(F.col("vec_id").alias("neighbour_key"), F.col("embedding").alias("n")), "neighbour_key")
    for r in syn.collect():
        s, n, x = np.array(r.s), np.array(r.n), np.array(r.embedding)
        assert 0.0 <= r.lam < 1.0
        assert np.allclose(x, s + r.lam * (n - s), atol=1e-5)


def test_stratified_folds_cover_each_row_once(spark):
    a = acc(spark, SF_SMALL).where(F.col("label").isNotNull()).select("account_id", "label")
    f = S.stratified_folds(a, "account_id", k=5)
    assert f.count() == a.count() == f.select("account_id").distinct().count()
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


def test_clustering_on_triangle_plus_tail(spark):
    v = spark.createDataFrame([(i,) for i in range(5)], "id long")
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "src long, dst long")
    c = {r.id: r.clustering_coefficient for r in G.clustering(v, e).collect()}
    assert c == {0: 1.0, 1: 1.0, 2: 1.0 / 3, 3: 0.0, 4: 0.0}


def test_oof_and_isotonic_invariants(spark):
    from riskloom.operators import models as M
    from riskloom.plans.q_models import _pca_table
    x, d = _pca_table(spark, SF_SMALL)
    tr = x.where(F.col("split") == "train")
    zoo = {"naive_bayes": M.model_zoo(d)["naive_bayes"]}
    oof = M.oof_matrix(tr, zoo, "fold", k=5)
    assert oof.count() == tr.count() == oof.select("account_id").distinct().count()
    iso = M.calibrate_isotonic(oof.select(F.col("p_naive_bayes").alias("score"), "label"), "score")
    probe = spark.createDataFrame([(i / 20,) for i in range(21)], "score double")
    ps = [r.cal_p for r in iso.transform(probe).orderBy("score").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(ps, ps[1:]))


def _brandes(n, edges):
    adj = {i: set() for i in range(n)}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    bc = [0.0] * n
    for s in range(n):
        order, pred, sigma, dist = [], {v: [] for v in range(n)}, [0.0] * n, [-1] * n
        sigma[s], dist[s] = 1.0, 0
        q = [s]
        while q:
            v = q.pop(0)
            order.append(v)
            for w in sorted(adj[v]):
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = [0.0] * n
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w]
    return [b / ((n - 1) * (n - 2)) for b in bc]


def test_betweenness_matches_brandes(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 3), (4, 5), (5, 6), (6, 4), (7, 8)]
    n = 10
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.betweenness_centrality for r in G.betweenness(v, e).collect()}
    exp = _brandes(n, edges)
    for i in range(n):
        assert abs(got[i] - exp[i]) < 1e-12


def test_chained_imputation_keeps_observed_cells(spark):
    from riskloom.operators.impute import impute_chained
    cols = ["posts", "account_age_days", "follow_unfollow_rate", "caption_similarity_score", "followers"]
    a = acc(spark, SF_SMALL).select("account_id", *cols)
    out = impute_chained(a, cols, max_iter=2)
    assert out.count() == a.count()
    assert out.where(" OR ".join(f"{c} IS NULL" for c in cols)).count() == 0
    j = a.join(out.select("account_id", *[F.col(c).alias(f"o_{c}") for c in cols]), "account_id")
    for c in cols:
        assert j.where(F.col(c).isNotNull() & (F.col(c).cast("double") != F.col(f"o_{c}"))).count() == 0


def test_svd_embedding_reconstructs_projection(spark):
    from riskloom.operators import text as TX
    d = Tables(spark, SF_SMALL).documents
    w = TX.tfidf(d)
    e = TX.svd_embed(w, dim=8)
    rows = {r.doc_id: r.embedding for r in e.collect()}
    assert all(len(v) == 8 for v in rows.values())
    # squared norms of U*S never exceed the (unit) row norms of the L2-normalised TF-IDF rows
    assert all(sum(x * x for x in v) <= 1.0 + 1e-9 for v in rows.values())


def test_alerts_of_several_batches_of_one_day_are_kept(spark, tmp_path):
    import datetime as dt

    from riskloom.streaming import monitor as MON
    day = dt.date(2024, 5, 1)
    schema = "alert_level string, username string, alert_date date, scan_id string"
    path = str(tmp_path / "alerts")
    for epoch, users in [(0, [("u1", "s1"), ("u2", "s2")]), (1, [("u3", "s3"), ("u1", "s4")]), (0, [("u1", "s1"), ("u2", "s2")])]:
        MON.write_alerts(spark.createDataFrame([("HIGH", u, day, s) for u, s in users], schema), path, epoch)
    got = {(r.username, r.scan_id) for r in MON.read_alerts(spark, path, schema).collect()}
    assert got == {("u1", "s4"), ("u2", "s2"), ("u3", "s3")}


def test_monitor_over_several_files_equals_the_batch_result(spark, tmp_path):
    from pyspark.sql import functions as F

    from riskloom.plans.q_stream import results, score_events
    from riskloom.streaming import monitor as MON
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for i in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    snaps = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
             .withColumn("username", name))
    watch = events.select(name.alias("username")).distinct()
    root, schema = str(tmp_path / "out"), "username string, scan_id string, alert_level string, alert_date date"
    want = {tuple(r) for r in MON.latest_alerts(MON.route_alerts(results(spark, SF_SMALL)))
            .select("alert_level", "username", "alert_date", "scan_id").collect()}
    for _ in range(2):                                            # the second start finds nothing new
        for q in MON.start_monitor(snaps, watch, lambda d: score_events(d.drop("username")), root + "/alerts",
                                   root + "/history", root + "/ckpt", {"availableNow": True}, "3650 days"):
            q.awaitTermination()
        got = [tuple(r) for r in MON.read_alerts(spark, root + "/alerts", schema)
               .select("alert_level", "username", "alert_date", "scan_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_imputation_of_one_incomplete_and_one_empty_column(spark):
    from riskloom.operators.impute import impute_chained
    rows = [(float(i), None if i % 5 == 0 else 2.0 * i, None) for i in range(40)]
    d = spark.createDataFrame(rows, "a double, b double, c double")
    got = impute_chained(d, ["a", "b", "c"], max_iter=2, trees=3).collect()
    assert len(got) == 40 and all(r.b is not None and r.c is None for r in got)
    assert all(r.b == 2 * r.a for r in got if r.a % 5)


def test_knn_ties_go_to_the_smallest_keys(spark):
    from riskloom.operators.neighbors import knn_exact
    d = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "id long, v array<double>").repartition(5)
    got = knn_exact(d.where("id = 150"), d, 5, "id", "id", "v")
    assert [r.rid for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_exact_quantiles_match_percentile(spark):
    from riskloom.operators.clean import exact_quantiles
    rng = np.random.default_rng(3)
    rows = [(float(x) if rng.random() > .1 else None, int(y), 7.0 if k % 3 else None, None)
            for k, (x, y) in enumerate(zip(rng.normal(size=401), rng.integers(0, 4, 401)))]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = exact_quantiles(df, ["a", "b", "c", "d"], shares)
    for c in ("a", "b", "c"):
        want = df.agg(F.percentile(c, F.array(*[F.lit(s) for s in shares]))).first()[0]
        assert np.allclose(got[c], want, rtol=1e-12, atol=0)
    assert got["d"] is None
    assert exact_quantiles(df.limit(0), ["a"], shares) == {"a": None}
    assert exact_quantiles(spark.createDataFrame([(2.5,)], "a double"), ["a"], shares) == {"a": [2.5] * 5}


def test_graph_keeps_every_peer_pair_and_pivots_are_the_callers(spark):
    a = spark.createDataFrame([(i, 100) for i in range(400)] + [(400, 0)], "account_id long, followers long")
    v, e = G.interaction_graph(a)
    assert e.count() == sum(min(9, 399 - i) for i in range(400))
    assert G.interaction_graph(a, limit=200)[1].count() == 200
    n = 9
    path = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    nodes = spark.range(n)
    every = {r.id: r.betweenness_centrality for r in G.betweenness(nodes, path).collect()}
    assert every == {r.id: r.betweenness_centrality for r in G.betweenness(nodes, path, pivots=n).collect()}
    assert abs(every[4] - 2 * 16 / ((n - 1) * (n - 2))) < 1e-12


def test_pagerank_says_when_it_does_not_converge(spark):
    import pytest
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    with pytest.raises(RuntimeError, match="did not converge"):
        G.pagerank(spark.range(4), e, max_iter=1)


def test_betweenness_in_tasks_equals_the_joins_by_level(spark, monkeypatch):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 3), (4, 5), (5, 6), (6, 4), (7, 8)]
    v = spark.createDataFrame([(i,) for i in [*range(10), 3, None]], "id long")
    e = spark.createDataFrame(edges, "src long, dst long")
    for pivots in (None, 5):
        monkeypatch.setattr(G, "TASK_EDGES", 100)
        got = G.betweenness(v, e, pivots)
        assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.id is None, r.id or 0, round(r.betweenness_centrality, 12)) for r in got.collect())
        monkeypatch.setattr(G, "TASK_EDGES", 0)
        assert got == sorted((r.id is None, r.id or 0, round(r.betweenness_centrality, 12)) for r in G.betweenness(v, e, pivots).collect())


def test_training_sees_every_peer_pair(spark, monkeypatch):
    from riskloom.plans import flow
    rows = spark.createDataFrame([(i, 100) for i in range(400)], "account_id long, followers long")
    asked = []
    monkeypatch.setattr(flow, "acc", lambda *a: rows)
    monkeypatch.setattr(flow, "metadata_features", lambda a, **k: a)
    monkeypatch.setattr(G, "label_propagation", lambda v, e, n: v)
    monkeypatch.setattr(G, "graph_features", lambda v, e, **k: (asked.append(e.count()), v.select("id", *[F.lit(0.0).alias(c) for c in G.GRAPH_FEATURES]))[1])
    assert flow.feature_table(spark, "").count() == 400
    assert asked == [sum(min(9, 399 - i) for i in range(400))]
