"""Save / load the fitted bundle as a folder of Spark ML models plus small
Parquet tables of the scalars (no pickles).  A missing folder is an error."""

from __future__ import annotations

import json
import os

from pyspark.ml import classification as C
from pyspark.ml.feature import PCAModel
from pyspark.ml.regression import IsotonicRegressionModel

from ..operators import models as M

_ML = {"GBTClassificationModel": C.GBTClassificationModel,
       "RandomForestClassificationModel": C.RandomForestClassificationModel,
       "NaiveBayesModel": C.NaiveBayesModel,
       "MultilayerPerceptronClassificationModel": C.MultilayerPerceptronClassificationModel,
       "LogisticRegressionModel": C.LogisticRegressionModel}


def save_bundle(spark, bundle: dict, path: str) -> None:
    kinds = {}
    for name, m in bundle["models"].items():
        p = os.path.join(path, "models", name)
        if isinstance(m, M.RFFSVMModel):
            kinds[name] = "RFFSVM"
            spark.createDataFrame([(json.dumps(m.W.tolist()), json.dumps(m.b.tolist()))], "W string, b string") \
                 .write.mode("overwrite").parquet(p + "/rff")
            m.svc.write().overwrite().save(p + "/svc")
            m.cal.model.write().overwrite().save(p + "/iso")
        elif isinstance(m, M.AdaBoostModel):
            kinds[name] = "AdaBoost"
            spark.createDataFrame([(json.dumps(m.alphas),)], "alphas string").write.mode("overwrite").parquet(p + "/a")
            for i, s in enumerate(m.stumps):
                s.write().overwrite().save(f"{p}/stump_{i}")
        elif isinstance(m, M.ForestInPartsModel):
            kinds[name] = f"ForestInParts {len(m.paths)}"
            for i, part in enumerate(m.paths):
                C.RandomForestClassificationModel.load(part).write().overwrite().save(f"{p}/part_{i}")
        else:
            kinds[name] = type(m).__name__
            m.write().overwrite().save(p)
    bundle["pca"].write().overwrite().save(os.path.join(path, "pca"))
    bundle["meta"].write().overwrite().save(os.path.join(path, "meta"))
    bundle["stats"].write.mode("overwrite").parquet(os.path.join(path, "stats"))
    scalars = {"names": bundle["names"], "model_names": bundle["model_names"], "kinds": kinds,
               "weights": bundle["weights"], "threshold": bundle["threshold"],
               "explained": [float(x) for x in bundle["explained"]]}
    spark.createDataFrame([(json.dumps(scalars),)], "scalars string").write.mode("overwrite") \
         .parquet(os.path.join(path, "scalars"))


def load_bundle(spark, path: str) -> dict:
    import numpy as np
    sc = json.loads(spark.read.parquet(os.path.join(path, "scalars")).first()["scalars"])  # raises if missing
    models = {}
    for name, kind in sc["kinds"].items():
        p = os.path.join(path, "models", name)
        if kind == "RFFSVM":
            r = spark.read.parquet(p + "/rff").first()
            svc = C.LinearSVCModel.load(p + "/svc")
            iso = M._Iso(IsotonicRegressionModel.load(p + "/iso"), "margin")
            models[name] = M.RFFSVMModel(np.array(json.loads(r["W"])), np.array(json.loads(r["b"])), svc, iso)
        elif kind == "AdaBoost":
            alphas = json.loads(spark.read.parquet(p + "/a").first()["alphas"])
            stumps = [C.DecisionTreeClassificationModel.load(f"{p}/stump_{i}") for i in range(len(alphas))]
            models[name] = M.AdaBoostModel(stumps, alphas)
        elif kind.startswith("ForestInParts "):
            models[name] = M.ForestInPartsModel([f"{p}/part_{i}" for i in range(int(kind.split()[1]))])
        else:
            models[name] = _ML[kind].load(p)
    return {"names": sc["names"], "model_names": sc["model_names"], "models": models, "weights": sc["weights"],
            "threshold": sc["threshold"], "explained": sc["explained"],
            "stats": spark.read.parquet(os.path.join(path, "stats")),
            "pca": PCAModel.load(os.path.join(path, "pca")),
            "meta": C.LogisticRegressionModel.load(os.path.join(path, "meta"))}
