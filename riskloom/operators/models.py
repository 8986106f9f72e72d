"""The classifier zoo, calibration, stacking and search on
Spark ML.  Every estimator consumes a `features` vector column and a `label`
column; fitted models are Spark ML models (distributed fit and transform).

Iterative learners (AdaBoost weights, fold loops) keep their per-round state as
DataFrame columns and cut lineage with reliable checkpoints.
"""

from __future__ import annotations

import logging
import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

log = logging.getLogger(__name__)
SEED = 42
#: Fits that run at the same time: one alone leaves most cores idle between its many small jobs.
FITS = 3
#: Folds that are fitted at the same time.
FOLDS = 2
#: Trees times training rows up to which a forest is fitted and scored at once: the driver holds all its nodes.
FOREST_ROWS = 1_000_000


def together(spark: SparkSession, steps: list[Callable], most: int) -> list:
    """What the steps return, in order; at most `most` run at a time.  The first that fails, in that order, ends the run."""
    if len(steps) < 2:
        return [s() for s in steps]
    with ThreadPoolExecutor(most) as pool:
        found = [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]
        try:
            return [f.result() for f in found]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


# --- M01-M10 estimators -----------------------------------------------------------

def model_zoo(n_features: int, trees: int = 200, boost_iters: int = 200, seed: int = SEED) -> dict:
    """Spark counterparts of the ten base models (reference hyper-parameters by default)."""
    return {
        "xgboost": GBTClassifier(maxIter=boost_iters, maxDepth=6, stepSize=0.1, subsamplingRate=0.8,
                                 featureSubsetStrategy="0.8", seed=seed),                         # M01
        "lightgbm": GBTClassifier(maxIter=boost_iters, maxDepth=5, stepSize=0.05, seed=seed),     # M02
        "catboost": GBTClassifier(maxIter=boost_iters, maxDepth=6, stepSize=0.05, seed=seed),     # M03
        "random_forest": ForestInParts(numTrees=trees, maxDepth=30, cacheNodeIds=True, seed=seed),  # M04
        "extra_trees": ForestInParts(numTrees=trees, maxDepth=30, bootstrap=False, cacheNodeIds=True,
                                              featureSubsetStrategy="sqrt", maxBins=8, seed=seed),  # M05
        "svm": RFFSVM(seed=seed),                                                                 # M06
        "naive_bayes": NaiveBayes(modelType="gaussian"),                                          # M08
        "mlp": MultilayerPerceptronClassifier(layers=[n_features, 128, 64, 2], maxIter=300, seed=seed),  # M09
        "adaboost": AdaBoostSAMME(rounds=100, seed=seed),                                         # M10
    }


class ForestInParts(RandomForestClassifier):
    """Spark ML's forest.  The driver holds the nodes of a forest, which grow with trees and rows, so beyond
    FOREST_ROWS the trees are fitted in parts with seeds of their own, each written before the next one is fitted."""

    def _fit(self, dataset: DataFrame):
        trees = self.getNumTrees()
        parts = min(trees, math.ceil(trees * dataset.count() / FOREST_ROWS))
        if parts <= 1:
            return super()._fit(dataset)
        spark, paths = dataset.sparkSession, []
        root = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
        for i in range(parts):
            size = trees * (i + 1) // parts - trees * i // parts
            model = RandomForestClassifier._fit(self.copy({self.numTrees: size, self.seed: self.getSeed() + i}), dataset)
            paths.append(f"{root}/part_{i}")
            model.write().save(paths[-1])
            del model
        return ForestInPartsModel(paths)


class ForestInPartsModel:
    """A forest as written parts.  A row's votes are the sum of the parts' votes; rows are written after each part, so that
    the driver and the tasks hold one part at a time."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_votes", F.array(F.lit(0.0), F.lit(0.0)))
        for path in self.paths:
            model = RandomForestClassificationModel.load(path).setRawPredictionCol("_part").setProbabilityCol("").setPredictionCol("")
            out = cut_lineage(model.transform(out).withColumn(
                "_votes", F.zip_with("_votes", vector_to_array("_part"), lambda a, b: a + b)).drop("_part"))
        total = F.col("_votes")[0] + F.col("_votes")[1]
        return (out.withColumn("rawPrediction", array_to_vector("_votes"))
                .withColumn("probability", array_to_vector(F.transform("_votes", lambda v: v / total)))
                .withColumn("prediction", (F.col("_votes")[1] > F.col("_votes")[0]).cast("double")).drop("_votes"))


class RFFSVM:
    """RBF-kernel margin classifier as random Fourier features (Rahimi &
    Recht 2007) + LinearSVC, isotonic-calibrated to probabilities (M11).
    gamma = 1/(n_features * var(X)) ('scale')."""

    def __init__(self, n_components: int = 200, reg: float = 0.01, seed: int = SEED):
        self.n_components, self.reg, self.seed = n_components, reg, seed

    def fit(self, df: DataFrame) -> "RFFSVMModel":
        d = len(df.select("features").first()["features"])
        var = df.select(F.explode(vector_to_array("features")).alias("x")).agg(F.var_pop("x")).first()[0] or 1.0
        gamma = 1.0 / (d * var) if var > 0 else 1.0
        rng = np.random.default_rng(self.seed)
        W = rng.normal(0.0, math.sqrt(2 * gamma), size=(self.n_components, d))
        b = rng.uniform(0, 2 * math.pi, size=self.n_components)
        mapped = _rff(df, W, b)
        svc = LinearSVC(regParam=self.reg, maxIter=100, featuresCol="rff").fit(mapped)
        cal = calibrate_isotonic(svc.transform(mapped).withColumn("margin", vector_to_array("rawPrediction")[1]),
                                 "margin")
        return RFFSVMModel(W, b, svc, cal)


class RFFSVMModel:
    def __init__(self, W, b, svc, cal):
        self.W, self.b, self.svc, self.cal = W, b, svc, cal

    def transform(self, df: DataFrame) -> DataFrame:
        m = self.svc.transform(_rff(df, self.W, self.b)).withColumn("margin", vector_to_array("rawPrediction")[1])
        m = self.cal.transform(m.withColumnRenamed("prediction", "svm_pred").drop("rawPrediction"))
        return m.withColumn("probability", array_to_vector(F.array(1 - F.col("cal_p"), F.col("cal_p")))) \
                .drop("rff", "margin", "cal_p", "svm_pred")


def _rff(df: DataFrame, W: np.ndarray, b: np.ndarray) -> DataFrame:
    """z(x) = sqrt(2/D) cos(W x + b), numpy per Arrow batch; W is bounded (D x d).
    Only the vector goes to Python, as an array; the other columns stay in the JVM."""
    from ..functions.udfs import fourier_map
    return df.withColumn("rff", array_to_vector(fourier_map(W, b)(vector_to_array("features"))))


class AdaBoostSAMME:
    """SAMME with depth-1 trees; sample weights are a column, rescaled each
    round; lineage is cut every 10 rounds."""

    def __init__(self, rounds: int = 100, seed: int = SEED):
        self.rounds, self.seed = rounds, seed

    def fit(self, df: DataFrame) -> "AdaBoostModel":
        n = df.count()
        x = df.select("features", "label").withColumn("w", F.lit(1.0 / n))
        stumps, alphas = [], []
        for m in range(self.rounds):
            stump = DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=self.seed).fit(x)
            p = stump.transform(x).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
            err = p.agg((F.sum(F.col("w") * F.col("miss")) / F.sum("w")).alias("e")).first()["e"]
            if err is None or err >= 0.5:
                break
            err = max(err, 1e-10)
            alpha = math.log((1 - err) / err)
            stumps.append(stump)
            alphas.append(alpha)
            x = p.select("features", "label", (F.col("w") * F.exp(F.lit(alpha) * F.col("miss"))).alias("w"))
            if (m + 1) % 10 == 0:
                x = cut_lineage(x)
            if err <= 1e-10:
                break
        return AdaBoostModel(stumps, alphas)


class AdaBoostModel:
    def __init__(self, stumps, alphas):
        self.stumps, self.alphas = stumps, alphas

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_s", F.lit(0.0))
        total = sum(self.alphas) or 1.0
        for i, (s, a) in enumerate(zip(self.stumps, self.alphas)):
            out = s.setPredictionCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_q{i}") \
                   .transform(out)
            out = out.withColumn("_s", F.col("_s") + a * (2 * F.col(f"_p{i}") - 1)).drop(f"_p{i}", f"_r{i}", f"_q{i}")
        p = 1 / (1 + F.exp(-2 * F.col("_s") / total))
        return out.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_s")


# --- M11 calibration ----------------------------------------------------------------

class _Iso:
    def __init__(self, model, col):
        self.model, self.col = model, col

    def transform(self, df):
        return self.model.setFeaturesCol(self.col).setPredictionCol("cal_p").transform(df)


def calibrate_isotonic(df: DataFrame, score_col: str):
    """Isotonic map score -> P(label=1) (monotone, increasing)."""
    return _Iso(IsotonicRegression(featuresCol=score_col, labelCol="label", predictionCol="cal_p",
                                   isotonic=True).fit(df.drop("cal_p")), score_col)


def calibrated_cv(est, df: DataFrame, folds: int = 3, fold_col: str = "cal_fold"):
    """Per fold, fit on the other folds and fit isotonic calibration on the
    held-out fold; prediction = mean of the fold-calibrated probabilities."""
    parts = []
    for i in range(folds):
        m = est.fit(df.where(F.col(fold_col) != i))
        held = m.transform(df.where(F.col(fold_col) == i)).withColumn("score", vector_to_array("probability")[1])
        cal = calibrate_isotonic(cut_lineage(held.select("score", "label")), "score")
        parts.append((_put_away(df.sparkSession, m), cal))
        del m, held
    return CalibratedModel(parts)


def _put_away(spark: SparkSession, model):
    """A forest is written, so that the driver does not hold the forests of all folds until they score; others stay."""
    if not isinstance(model, RandomForestClassificationModel):
        return model
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    model.write().save(path)
    return PutAway(path)


class PutAway:
    """A written forest, read when it is needed."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> RandomForestClassificationModel:
        return RandomForestClassificationModel.load(self.path)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.load().transform(df)


class CalibratedModel:
    def __init__(self, parts):
        self.parts = parts

    def transform(self, df: DataFrame) -> DataFrame:
        out, cols = df, []
        for i, (m, iso) in enumerate(self.parts):
            s = m.transform(out.select(*out.columns)).withColumn("score", vector_to_array("probability")[1])
            s = iso.transform(s).select(*out.columns, F.col("cal_p").alias(f"_c{i}"))
            out = cut_lineage(s) if isinstance(m, PutAway) else s
            cols.append(f"_c{i}")
        p = sum(F.col(c) for c in cols) / len(cols)
        return out.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop(*cols)


# --- M12-M13 ------------------------------------------------------------------------

def train_zoo(df: DataFrame, zoo: dict, skip_failed: bool = False) -> dict:
    """Fit every estimator on one cached vector table.  A failure ends the run; with `skip_failed` it is
    logged and the model left out, and the caller has to report it."""
    def fit(name):
        try:
            return zoo[name].fit(df)
        except Exception as ex:  # noqa: BLE001 (the reference skips a failing model)
            if not skip_failed:
                raise RuntimeError(f"model {name} failed to train") from ex
            log.warning("model %s failed: %s", name, str(ex)[:300])
            return None

    found = zip(zoo, together(df.sparkSession, [lambda name=name: fit(name) for name in zoo], FITS))
    return {name: model for name, model in found if model is not None}


def probability_matrix(df: DataFrame, models: dict, names: list[str] | None = None, complete: bool = False) -> DataFrame:
    """One p_<model> column per model (P(label=1)); a model that is missing or
    fails at plan time contributes 0.5, or ends the run if the matrix must be `complete`."""
    out = df
    for name in names or list(models):
        m = models.get(name)
        col = f"p_{name}"
        if m is None:
            if complete:
                raise RuntimeError(f"model {name} was not trained")
            out = out.withColumn(col, F.lit(0.5))
            continue
        try:
            base = out.columns
            t = m.transform(out)
            for c in ("prediction", "rawPrediction"):
                if c in t.columns and c not in base:
                    t = t.drop(c)
            out = t.withColumn(col, vector_to_array("probability")[1]).drop("probability")
        except Exception as ex:  # noqa: BLE001
            if complete:
                raise RuntimeError(f"model {name} failed to score") from ex
            log.warning("model %s failed to score: %s", name, str(ex)[:300])
            out = out.withColumn(col, F.lit(0.5))
    return out


# --- M14 search -------------------------------------------------------------------------

def random_search(df: DataFrame, n_trials: int = 10, folds: int = 3, seed: int = SEED, fold_col: str = "cv_fold"):
    """Seeded random parameter maps over the boosted-trees estimator (9 ranges,
    3 log-scaled), scored by 3-fold F1 via CrossValidator with a fold column."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator
    rng = np.random.default_rng(seed)
    gbt = GBTClassifier(seed=seed)
    maps = []
    for _ in range(n_trials):
        maps.append({gbt.maxIter: int(rng.integers(10, 60)), gbt.maxDepth: int(rng.integers(3, 9)),
                     gbt.stepSize: float(np.exp(rng.uniform(np.log(0.01), np.log(0.3)))),
                     gbt.subsamplingRate: float(rng.uniform(0.6, 1.0)),
                     gbt.featureSubsetStrategy: str(round(float(rng.uniform(0.6, 1.0)), 2)),
                     gbt.minInstancesPerNode: int(rng.integers(1, 10)),
                     gbt.minInfoGain: float(np.exp(rng.uniform(np.log(1e-8), np.log(1.0)))) * 0.01,
                     gbt.maxBins: int(rng.choice([16, 32, 64])),
                     gbt.minWeightFractionPerNode: float(np.exp(rng.uniform(np.log(1e-4), np.log(0.1)))) * 0.1})
    ev = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=maps, evaluator=ev, numFolds=folds, foldCol=fold_col,
                        parallelism=2, seed=seed)
    m = cv.fit(df)
    best = int(np.argmax(m.avgMetrics))
    return {p.name: v for p, v in maps[best].items()}, m.avgMetrics


# --- M19-M20 stacking -------------------------------------------------------------------

def oof_matrix(df: DataFrame, zoo: dict, fold_col: str = "fold", k: int = 5, graph_col: str | None = None,
               default_graph_risk: float = 0.15) -> DataFrame:
    """Every row scored by models that never saw it (5 folds); last column
    graph risk (or .15).  A fold whose model fails ends the run: the reference's
    0.5 could not be told from a score."""
    def fold(i):
        models = train_zoo(df.where(F.col(fold_col) != i), zoo)
        return cut_lineage(probability_matrix(df.where(F.col(fold_col) == i), models, list(zoo), complete=True))

    parts = together(df.sparkSession, [lambda i=i: fold(i) for i in range(k)], FOLDS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("graph_risk", F.col(graph_col) if graph_col else F.lit(default_graph_risk))


def meta_learner(df: DataFrame, cols: list[str], C: float = 1.0) -> Model:
    """Logistic meta-learner, L2, no standardisation; sklearn's C weighs a
    summed loss, Spark's regParam a mean loss -> regParam = 1/(C n) (trap T17)."""
    from pyspark.ml.feature import VectorAssembler
    n = df.count()
    x = VectorAssembler(inputCols=cols, outputCol="meta").transform(df)
    return LogisticRegression(featuresCol="meta", regParam=1.0 / (C * n), elasticNetParam=0.0,
                              standardization=False, maxIter=100).fit(x)


def meta_probability(df: DataFrame, model, cols: list[str], out_col: str = "final_p") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=cols, outputCol="meta").transform(df)
    return model.transform(x).withColumn("_meta_p", vector_to_array("probability")[1]) \
                .drop("meta", "rawPrediction", "probability", "prediction").withColumnRenamed("_meta_p", out_col)

