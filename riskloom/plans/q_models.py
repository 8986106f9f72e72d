"""Queries for vectors, PCA, the model zoo, stacking and the flows.

Learned outputs are checked by invariants (tests), not by SQL.  The forests
(m04, m05), the MLP (m09) and the whole zoo (m12) train with the operators'
counts, which are the reference's; the other model queries train with reduced
tree/iteration counts (20 instead of 200)."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators.features import FEATURE_NAMES
from ..operators.graph import MAX_EDGES_PER_TIER
from ..operators.pca import component_report, fit_pca, loadings_table
from ..operators.sampling import stratified_folds, stratified_split
from ..operators.vectors import scaler_stats, standardize
from ..session import cut_lineage
from . import flow
from .common import round_doubles, with_accounts
from .registry import query
from .sql_features import FEATURES_SQL

QUERY_TREES = 20
NAMES = [f"f_{n}" for n in FEATURE_NAMES]

_STATS = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in FEATURE_NAMES)
_Z = ", ".join(f"round(CASE WHEN s_{n} = 0 OR s_{n} IS NULL THEN 0.0 ELSE ({n} - m_{n}) / s_{n} END, 6) AS z_f_{n}"
               for n in FEATURE_NAMES)


@query("v06_standardize", with_accounts(f"SELECT account_id, {_Z} FROM features, (SELECT {_STATS} FROM features)",
                                        FEATURES_SQL))
def v06_standardize(spark, sf_dir):
    f = flow.feature_table(spark, sf_dir, with_graph=False)
    return round_doubles(standardize(f, NAMES, prefix="z_", keep=["account_id"]))


_PAD = ["f_account_age_days", "f_posts_per_day", "f_caption_similarity_score"]


_PRESENT = ["log_followers", "posts", "username_entropy"]


@query("v07_pad_training_means", with_accounts(
    "SELECT account_id, " + ", ".join(f"0.0 AS z_{n}" for n in _PAD) + ", " + ", ".join(
        f"round(CASE WHEN s_{n} = 0 OR s_{n} IS NULL THEN 0.0 ELSE ({n} - m_{n}) / s_{n} END, 6) AS z_f_{n}" for n in _PRESENT)
    + f" FROM features, (SELECT {_STATS} FROM features WHERE label IS NOT NULL)", FEATURES_SQL))
def v07_pad_training_means(spark, sf_dir):
    """Scaler fitted on labelled rows; all rows scored without three trained columns: those get the training
    mean (z = 0) by name, and the others keep their own statistics."""
    f = flow.feature_table(spark, sf_dir, with_graph=False)
    stats = scaler_stats(f.where(F.col("label").isNotNull()), NAMES)
    z = standardize(f.drop(*_PAD), NAMES, stats=stats, prefix="z_", keep=["account_id"])
    return round_doubles(z.select("account_id", *[f"z_{n}" for n in _PAD], *[f"z_f_{n}" for n in _PRESENT]))


def _prepared(spark, sf_dir, graph=False):
    names = flow._names(graph)
    base = flow.feature_table(spark, sf_dir, with_graph=graph, limit=MAX_EDGES_PER_TIER).where(F.col("label").isNotNull())
    base = stratified_split(base, "account_id")
    tr = base.where(F.col("split") == "train")
    stats = cut_lineage(scaler_stats(tr, names))
    return cut_lineage(flow.prepare(base, names, stats)), names


@query("v05_assemble")
def v05_assemble(spark, sf_dir):
    """Metadata + graph columns joined on the key (gaps -> 0) and assembled."""
    x, names = _prepared(spark, sf_dir, graph=True)
    return x.select("account_id", vector_to_array("features").alias("features"))


@query("v08_pca_fit")
def v08_pca_fit(spark, sf_dir):
    x, names = _prepared(spark, sf_dir)
    model, explained = fit_pca(x.where(F.col("split") == "train"))
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(explained)], "component int, explained double")


@query("v09_pca_projection")
def v09_pca_projection(spark, sf_dir):
    x, names = _prepared(spark, sf_dir)
    model, _ = fit_pca(x.where(F.col("split") == "train"))
    return model.transform(x).select("account_id", vector_to_array("pca").alias("components"))


@query("x07_component_report")
def x07_component_report(spark, sf_dir):
    x, names = _prepared(spark, sf_dir)
    model, explained = fit_pca(x.where(F.col("split") == "train"))
    return component_report(loadings_table(spark, model, [n[2:] for n in names], explained))


def _pca_table(spark, sf_dir):
    x, names = _prepared(spark, sf_dir)
    model, explained = fit_pca(x.where(F.col("split") == "train"))
    p = model.transform(x).drop("features").withColumnRenamed("pca", "features")
    return cut_lineage(stratified_folds(p, "account_id", k=5)), len(explained)


def _model_query(name):
    def run(spark, sf_dir):
        x, d = _pca_table(spark, sf_dir)
        est = M.model_zoo(d, boost_iters=QUERY_TREES)[name]
        if isinstance(est, M.AdaBoostSAMME):
            est.rounds = QUERY_TREES
        m = est.fit(x.where(F.col("split") == "train"))
        out = M.probability_matrix(x.where(F.col("split") == "test"), {name: m}, [name])
        return out.select("account_id", "label", f"p_{name}")
    return run


for _id, _name in [("m01", "xgboost"), ("m02", "lightgbm"), ("m03", "catboost"), ("m04", "random_forest"),
                   ("m05", "extra_trees"), ("m06", "svm"), ("m08", "naive_bayes"), ("m09", "mlp"),
                   ("m10", "adaboost")]:
    query(f"{_id}_{_name}")(_model_query(_name))


@query("m11_isotonic_calibration")
def m11_isotonic_calibration(spark, sf_dir):
    x, d = _pca_table(spark, sf_dir)
    tr = x.where(F.col("split") == "train").withColumn("cal_fold", F.pmod(F.col("fold"), F.lit(3)))
    cal = M.calibrated_cv(M.model_zoo(d, trees=QUERY_TREES)["random_forest"], tr, folds=3)
    return cal.transform(x.where(F.col("split") == "test")) \
              .select("account_id", "label", vector_to_array("probability")[1].alias("p_calibrated"))


def _small_zoo(d):
    z = M.model_zoo(d, trees=QUERY_TREES, boost_iters=QUERY_TREES)
    return {k: z[k] for k in ("xgboost", "random_forest", "naive_bayes")}


@query("m12_train_zoo")
def m12_train_zoo(spark, sf_dir):
    x, d = _pca_table(spark, sf_dir)
    zoo = M.model_zoo(d)
    fitted = M.train_zoo(x.where(F.col("split") == "train"), zoo, skip_failed=True)
    return spark.createDataFrame([(k, k in fitted) for k in zoo], "model string, fitted boolean")


@query("m13_probability_matrix")
def m13_probability_matrix(spark, sf_dir):
    x, d = _pca_table(spark, sf_dir)
    zoo = _small_zoo(d)
    fitted = M.train_zoo(x.where(F.col("split") == "train"), zoo)
    fitted["missing_model"] = None
    pm = M.probability_matrix(x.where(F.col("split") == "test"), fitted, list(zoo) + ["missing_model"])
    return pm.select("account_id", "label", *[f"p_{k}" for k in list(zoo) + ["missing_model"]])


@query("m14_random_search")
def m14_random_search(spark, sf_dir):
    x, d = _pca_table(spark, sf_dir)
    tr = x.where(F.col("split") == "train").withColumn("cv_fold", F.pmod(F.col("fold"), F.lit(3)))
    best, metrics = M.random_search(tr, n_trials=3)
    return spark.createDataFrame([(k, str(v)) for k, v in best.items()], "param string, value string")


@query("m19_oof_matrix")
def m19_oof_matrix(spark, sf_dir):
    x, d = _pca_table(spark, sf_dir)
    tr = x.where(F.col("split") == "train")
    oof = M.oof_matrix(tr, _small_zoo(d), "fold", k=5)
    return oof.select("account_id", "label", "fold", "p_xgboost", "p_random_forest", "p_naive_bayes", "graph_risk")


@query("m20_meta_learner")
def m20_meta_learner(spark, sf_dir):
    x, d = _pca_table(spark, sf_dir)
    tr = x.where(F.col("split") == "train")
    zoo = _small_zoo(d)
    oof = cut_lineage(M.oof_matrix(tr, zoo, "fold", k=5))
    cols = [f"p_{k}" for k in zoo] + ["graph_risk"]
    meta = M.meta_learner(oof, cols)
    return M.meta_probability(oof, meta, cols, "final_p").select("account_id", "label", "final_p")


def _bundle(spark, sf_dir):
    return flow.train(spark, sf_dir, trees=QUERY_TREES, boost_iters=QUERY_TREES,
                      models=["xgboost", "random_forest", "naive_bayes"], with_graph=True)


@query("m28_train_flow")
def m28_train_flow(spark, sf_dir):
    return _bundle(spark, sf_dir)["metrics"]


@query("m29_score_flow")
def m29_score_flow(spark, sf_dir):
    return flow.score(spark, sf_dir, _bundle(spark, sf_dir))


@query("x05_back_projection")
def x05_back_projection(spark, sf_dir):
    b = _bundle(spark, sf_dir)
    s = flow.score_table(flow.feature_table(spark, sf_dir, with_graph=False), b)
    e = flow.explain_scores(s, b)
    return e.select("account_id", F.posexplode("top_attributions").alias("rank", "a")).select("account_id", "rank",
                                                                                               "a.*")


@query("risk_report")
def risk_report(spark, sf_dir):
    """The flagship (entry) on any scale."""
    return flow.risk_report(spark, sf_dir)


@query("s10_bundle_roundtrip")
def s10_bundle_roundtrip(spark, sf_dir):
    """Train, save, load again and score with the loaded bundle."""
    import uuid

    from ..session import scratch_path
    from .bundle import load_bundle, save_bundle
    b = flow.train(spark, sf_dir, trees=QUERY_TREES, boost_iters=QUERY_TREES, with_graph=False,
                   models=["random_forest", "naive_bayes"])
    path = scratch_path(spark, f"bundle-{uuid.uuid4().hex}")
    save_bundle(spark, b, path)
    loaded = load_bundle(spark, path)
    return flow.score(spark, sf_dir, loaded).select("account_id", "label", "probability", "risk_band")
