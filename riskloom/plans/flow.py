"""M28 (train) and M29 (score) flows, and the flagship risk report.

Fixes the reference's evaluation flaws (SURVEY 5.2): split first; scaler, PCA
and models are fitted on training rows only; weights and threshold are tuned
on a validation fold of the training rows; metrics use untouched test rows.
Actions happen only where something is fitted; scoring is one lazy plan.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import explain as X
from ..operators import graph as G
from ..operators import metrics as MT
from ..operators import models as M
from ..operators import output as O
from ..operators.features import FEATURE_NAMES, metadata_features
from ..operators.fusion import fitted_weights, optimal_threshold, threshold_predict, vote_weights
from ..operators.pca import fit_pca, loadings
from ..operators.sampling import stratified_folds, stratified_split
from ..operators.vectors import scaler_stats, standardize
from ..session import cut_lineage
from .common import acc

GRAPH_NAMES = list(G.GRAPH_FEATURES)
PIVOTS = 100


def feature_table(spark, sf_dir, with_graph: bool = True, limit: int | None = None) -> DataFrame:
    """Accounts + F01-F34 (prefixed f_) + the 5 graph metrics (V05: left join, gaps -> 0) of the graph of
    all peer pairs, or of at most `limit` a tier (G03)."""
    a = acc(spark, sf_dir)
    f = metadata_features(a, keep=a.columns, prefix="f_")
    if not with_graph:
        return f
    v, e = (cut_lineage(x) for x in G.interaction_graph(a, limit=limit))
    # five-round labels: the search for communities by modularity would take minutes in every flow
    gf = G.graph_features(v, e, communities=G.label_propagation(v, e, 5), pivots=PIVOTS).withColumnRenamed("id", "account_id")
    return f.join(gf, "account_id", "left").na.fill(0.0, GRAPH_NAMES)


def _names(with_graph):
    return [f"f_{n}" for n in FEATURE_NAMES] + (GRAPH_NAMES if with_graph else [])


def prepare(df: DataFrame, names: list[str], stats: DataFrame) -> DataFrame:
    z = standardize(df, names, stats=stats, prefix="z_", keep=df.columns)
    return VectorAssembler(inputCols=[f"z_{n}" for n in names], outputCol="features").transform(z)


def train(spark, sf_dir, trees: int = 200, boost_iters: int = 200, with_graph: bool = True,
          models: list[str] | None = None, oof_folds: int = 5) -> dict:
    """Returns the fitted bundle and test metrics."""
    names = _names(with_graph)
    base = cut_lineage(feature_table(spark, sf_dir, with_graph).where(F.col("label").isNotNull()))
    base = cut_lineage(stratified_split(base, "account_id"))
    tr, te = base.where(F.col("split") == "train"), base.where(F.col("split") == "test")
    stats = cut_lineage(scaler_stats(tr, names))
    tr, te = prepare(tr, names, stats), prepare(te, names, stats)
    pca, explained = fit_pca(tr)
    tr = cut_lineage(stratified_folds(pca.transform(tr).drop("features").withColumnRenamed("pca", "features"),
                                      "account_id", k=oof_folds))
    te = pca.transform(te).drop("features").withColumnRenamed("pca", "features")
    zoo = M.model_zoo(len(explained), trees=trees, boost_iters=boost_iters)
    if models:
        zoo = {k: v for k, v in zoo.items() if k in models}
    fit_part, val = tr.where(F.col("fold") != 0), tr.where(F.col("fold") == 0)
    fitted = M.train_zoo(fit_part, zoo)
    pcols = [f"p_{n}" for n in zoo]
    vp = cut_lineage(M.probability_matrix(val, fitted, list(zoo), complete=True))
    del fitted                                            # the driver need not hold these forests beside those of the folds
    weights = fitted_weights(vote_weights(vp, pcols))
    oof = M.oof_matrix(tr, zoo, "fold", k=oof_folds)
    meta_cols = pcols + ["graph_risk"]
    meta = M.meta_learner(oof, meta_cols)
    # the threshold is tuned on the score it is applied to, over out-of-fold rows
    threshold = optimal_threshold(M.meta_probability(oof, meta, meta_cols, "probability"), "probability").first()["threshold"]
    final = M.train_zoo(tr, zoo)
    bundle = {"names": names, "stats": stats, "pca": pca, "explained": explained, "models": final,
              "weights": weights, "threshold": threshold, "meta": meta, "model_names": list(zoo)}
    scored = score_table(te, bundle, prepared=True)
    bundle["metrics"] = MT.evaluate(scored.withColumn("score", F.col("probability")), "label", "pred", "score")
    return bundle


def score_table(df: DataFrame, bundle: dict, prepared: bool = False) -> DataFrame:
    """Features (no fit) -> probabilities -> default graph risk .15 -> meta-learner
    -> threshold.  One lazy plan (no action)."""
    x = df
    if not prepared:
        x = prepare(df, bundle["names"], bundle["stats"])
        x = bundle["pca"].transform(x).drop("features").withColumnRenamed("pca", "features")
    pm = M.probability_matrix(x, bundle["models"], bundle["model_names"], complete=True)
    pm = pm.withColumn("graph_risk", F.lit(O.DEFAULT_GRAPH_RISK))
    pcols = [f"p_{n}" for n in bundle["model_names"]]
    out = M.meta_probability(pm, bundle["meta"], pcols + ["graph_risk"], "probability")
    return threshold_predict(out, "probability", bundle["threshold"])


def explain_scores(df: DataFrame, bundle: dict) -> DataFrame:
    """X04 explainer -> attributions over PCA components (X01 of the preferred
    tree model, X02 magnitude only where no tree model is fitted) -> X05
    back-projection with the loadings -> X06 ranking."""
    k = len(bundle["explained"])
    chosen = A.choose_explainer(bundle["models"])
    if chosen == "magnitude":
        df = df.withColumn("_pc", F.transform(vector_to_array("features"), lambda v: v * 0.01))
    else:
        paths = A.leaf_paths(A.first_estimator(bundle["models"][chosen]))
        pc = A.tree_attributions(df, paths, "account_id", k).select("account_id", F.col("attributions").alias("_pc"))
        df = df.join(pc, "account_id")
    names = [n[2:] if n.startswith("f_") else n for n in bundle["names"]]
    orig = X.back_project(F.col("_pc"), loadings(bundle["pca"]), names)
    return df.withColumn("top_attributions", F.slice(X.rank_estimated(orig, 10), 1, 5)).drop("_pc")


def score(spark, sf_dir, bundle: dict) -> DataFrame:
    """Full scoring of every account (labelled or not) into the result record."""
    f = feature_table(spark, sf_dir, with_graph=False)   # graph columns absent -> training means (V07)
    s = score_table(f, bundle)
    s = explain_scores(s, bundle)
    return O.result_record(s, graph_col="graph_risk")


# --------------------------------------------------------------------- flagship

def risk_report(spark, sf_dir) -> DataFrame:
    """Flagship: accounts -> F01-F34 -> V06 -> logistic score fitted on the
    labelled training split (M20 form) -> threshold sweep (M17) -> exact linear
    attributions coef_j * z_j -> X06 ranking -> O05 record per account."""
    names = [f"f_{n}" for n in FEATURE_NAMES]
    f = cut_lineage(feature_table(spark, sf_dir, with_graph=False))     # joins + features computed once
    lab = stratified_split(f.where(F.col("label").isNotNull()).select("account_id", "label"), "account_id")
    f = f.join(lab.select("account_id", "split"), "account_id", "left")
    stats = cut_lineage(scaler_stats(f.where(F.col("split") == "train"), names))
    z = cut_lineage(prepare(f, names, stats))
    tr = z.where(F.col("split") == "train")
    lr = LogisticRegression(regParam=0.01, maxIter=100).fit(tr)
    scored = lr.transform(z).withColumn("probability", vector_to_array("probability")[1]) \
               .drop("rawPrediction", "prediction")
    thr = optimal_threshold(scored.where(F.col("split") == "train"), "probability").first()["threshold"]
    scored = threshold_predict(scored, "probability", thr)
    coef = lr.coefficients.toArray().tolist()
    attr = F.array(*[F.struct(F.lit(n[2:]).alias("name"), (F.col(f"z_{n}") * F.lit(c)).alias("value"))
                     for n, c in zip(names, coef)])
    scored = scored.withColumn("top_attributions", F.slice(X.rank_estimated(attr, 10), 1, 5))
    return O.result_record(scored)

