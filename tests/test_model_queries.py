"""Model queries: full counts, failures that show, parts of forests."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import models as M
from riskloom.plans import q_models as Q

class Broken:
    def fit(self, df):
        raise ValueError("no fit")

class Unscorable:
    def transform(self, df):
        raise ValueError("no score")

@pytest.fixture(scope="module")
def rows(spark):
    return (spark.range(60, numPartitions=3)
            .select(F.col("id").alias("account_id"), F.array(F.rand(1), F.rand(2)).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"),
                    (F.col("id") % 2).cast("int").alias("fold"))
            .select("account_id", array_to_vector("x").alias("features"), "label", "fold").cache())

def test_a_failing_model_ends_training_unless_the_caller_reports_it(rows):
    zoo = {"bad": Broken(), "naive_bayes": M.model_zoo(2)["naive_bayes"]}
    with pytest.raises(RuntimeError, match="bad failed to train"):
        M.train_zoo(rows, zoo)
    assert list(M.train_zoo(rows, zoo, skip_failed=True)) == ["naive_bayes"]

def test_out_of_fold_scores_are_never_stand_ins(rows):
    with pytest.raises(RuntimeError, match="bad failed to train"):
        M.oof_matrix(rows, {"bad": Broken()}, k=2)
    with pytest.raises(RuntimeError, match="failed to score"):
        M.probability_matrix(rows, {"bad": Unscorable()}, complete=True)
    with pytest.raises(RuntimeError, match="not trained"):
        M.probability_matrix(rows, {}, ["bad"], complete=True)
    assert {r.p_bad for r in M.probability_matrix(rows, {"bad": Unscorable()}).collect()} == {0.5}

@pytest.fixture
def asked(spark, rows, monkeypatch):
    """What the queries train, without training it."""
    seen = {}

    def train(df, zoo, **how):
        seen.update(zoo)
        return {k: None for k in zoo if k != "svm"}

    monkeypatch.setattr(M, "train_zoo", train)
    monkeypatch.setattr(Q, "_pca_table", lambda *a: (rows.withColumn("split", F.lit("train")), 2))
    return seen

def test_the_zoo_query_trains_every_model_in_full_and_names_failures(spark, asked):
    got = {r.model: r.fitted for r in Q.m12_train_zoo(spark, "").collect()}
    assert got == {k: k != "svm" for k in M.model_zoo(2)}
    assert [asked[k].getMaxIter() for k in ("xgboost", "lightgbm", "catboost")] == [200] * 3
    assert asked["random_forest"].getNumTrees() == asked["extra_trees"].getNumTrees() == 200
    assert asked["adaboost"].rounds == 100 and asked["mlp"].getMaxIter() == 300

def test_forest_and_mlp_queries_train_in_full(spark, rows, monkeypatch):
    class Stop(Exception):
        pass

    def stop(est, df):
        raise Stop(est.getNumTrees() if hasattr(est, "getNumTrees") else est.getMaxIter())

    monkeypatch.setattr(Q, "_pca_table", lambda *a: (rows.withColumn("split", F.lit("train")), 2))
    for kind in ("random_forest", "extra_trees", "mlp"):
        monkeypatch.setattr(type(M.model_zoo(2)[kind]), "_fit", stop)
        with pytest.raises(Stop, match="300" if kind == "mlp" else "200"):
            Q._model_query(kind)(spark, "")


@pytest.fixture(scope="module")
def more(spark):
    x = spark.range(300, numPartitions=2).select(F.col("id").alias("account_id"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("x"))
    return x.withColumn("label", (F.col("x")[0] + F.col("x")[1] * F.rand(5) > 0.8).cast("int")).select(
        "account_id", array_to_vector("x").alias("features"), "label", (F.col("account_id") % 3).cast("int").alias("cal_fold")).cache()


def test_a_large_forest_is_fitted_and_scored_in_written_parts(spark, more, monkeypatch, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel as Whole

    from riskloom.operators import attribution as A
    from riskloom.plans import bundle as B
    forest = M.model_zoo(3, trees=7)["random_forest"]
    assert isinstance(forest.fit(more), Whole)
    monkeypatch.setattr(M, "FOREST_ROWS", 3 * 300)
    model = forest.fit(more)
    parts = [Whole.load(p) for p in model.paths]
    assert [p.getNumTrees for p in parts] == [2, 2, 3]
    got = {r.account_id: r for r in model.transform(more).collect()}
    raw = [{r.account_id: r.rawPrediction.toArray() for r in p.transform(more).collect()} for p in parts]
    for i, r in got.items():
        votes = sum(p[i] for p in raw)
        assert np.allclose(r.rawPrediction.toArray(), votes) and np.allclose(r.probability.toArray(), votes / 7)
        assert r.prediction == float(votes[1] > votes[0])
    # the explainer follows all parts, in tasks as well as on the driver
    paths = sorted(map(str, A.leaf_paths(model).collect()))
    monkeypatch.setattr(A, "DRIVER_NODES", 0)
    assert paths == sorted(map(str, A.leaf_paths(model).collect()))
    assert A.choose_explainer({"random_forest": model}) == "random_forest"
    one = A.tree_attributions(more, A.leaf_paths(model), "account_id", 3)
    for r in one.collect():
        assert abs(r.base + sum(r.attributions) - got[r.account_id].probability[1]) < 1e-9
    # and a saved bundle holds them
    kept = {"models": {"random_forest": model}, "pca": _pca(more), "meta": _meta(more), "stats": more.limit(1).select("label"), "names": [],
            "model_names": ["random_forest"], "weights": [], "threshold": 0.5, "explained": []}
    B.save_bundle(spark, kept, f"file://{tmp_path}/b")
    again = B.load_bundle(spark, f"file://{tmp_path}/b")["models"]["random_forest"]
    assert {r.account_id: r.probability for r in again.transform(more).collect()} == {i: r.probability for i, r in got.items()}


def _pca(x):
    from pyspark.ml.feature import PCA
    return PCA(k=2, inputCol="features", outputCol="pca").fit(x)


def _meta(x):
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression().fit(x)


def test_calibration_puts_the_forests_of_its_folds_away(more):
    forest = M.model_zoo(3, trees=3)["random_forest"]
    cal = M.calibrated_cv(forest, more)
    assert all(isinstance(m, M.PutAway) for m, _ in cal.parts)
    plain = M.CalibratedModel([(m.load(), iso) for m, iso in cal.parts])
    want = {r.account_id: r.probability for r in plain.transform(more).collect()}
    assert {r.account_id: r.probability for r in cal.transform(more).collect()} == want


def test_fits_run_together_and_keep_their_order(spark, rows):
    import threading
    both = threading.Barrier(2, timeout=60)

    class Waits:
        def __init__(self, name):
            self.name = name

        def fit(self, df):
            both.wait()                                          # one at a time would never get past this
            return self.name

    assert M.train_zoo(rows, {"b": Waits("x"), "a": Waits("y")}) == {"b": "x", "a": "y"}
    with pytest.raises(ValueError, match="second"):
        M.together(spark, [lambda: 1, lambda: (_ for _ in ()).throw(ValueError("second")), lambda: 3], 2)
