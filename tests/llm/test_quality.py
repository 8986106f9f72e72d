import random

import numpy as np

from riskloom.llm import quality

from .helpers import ODD, crc, docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.op7_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    away = [i for i in labels if crc(i) % 4 == 2]
    assert all(got[i].held_out == (crc(i) % 4 == 2) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert sum(got[i].predicted == labels[i] for i in away) >= 0.95 * len(away)


def test_flat_arrays_give_what_the_fit_saw():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.BoostedTrees().fit(x, y)

    def walk(row):
        raw = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            raw += leaf[node - len(f)]
        return 1 / (1 + np.exp(-raw))

    scores = model.score(x)
    assert np.allclose(scores[:100], [walk(r) for r in x[:100]])
    assert ((scores > 0.5) == (y > 0)).mean() > 0.98


def test_held_out_labels_are_not_used(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("good" if i % 2 else "BAD!!" for _ in range(rng.randrange(5, 40)))) for i in range(200)]
    labels = [(i, i % 2) for i in range(200)]
    turned = [(i, 1 - q if crc(i) % 4 == 2 else q) for i, q in labels]
    a, b = (sorted(map(tuple, quality.quality_scores(docs(spark, rows), spark.createDataFrame(x, "doc_id long, quality int"))
                       .collect())) for x in (labels, turned))
    assert a == b and all(p == i % 2 for i, _, _, p in a)


def test_odd_rows(spark):
    d = docs(spark, ODD)
    for labels in ([], [(1, 1), (2, 0), (2, 1), (4, None), (5, 0), (None, 1), (77, 0), (6, 3)]):
        got = quality.quality_scores(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(d.limit(0), none).count() == 0
    assert all(np.isfinite(quality.statistics(r[1])).all() and len(quality.statistics(r[1])) == len(quality.STATISTICS)
               for r in ODD)
