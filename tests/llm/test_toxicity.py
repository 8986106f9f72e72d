import math
import random
import re
from collections import Counter

import numpy as np

from riskloom.llm import toxicity

from .helpers import ODD, close, crc, docs

BAD = ("grumph", "snarlig", "blotch", "vexor")


def brute(rows, labels, min_texts=toxicity.MIN_TEXTS, min_deviation=toxicity.MIN_DEVIATION):
    """rows of (id, text) with distinct ids and texts, labels by id -> {id: (log ratio, score)}, written out plainly."""
    found = {i: re.findall(r"\w+", (t or "").lower()) for i, t in rows}
    known = [i for i in found if i in labels and crc(i) % 5]
    fit, apart = [i for i in known if crc(i) // 5 % 4], [i for i in known if crc(i) // 5 % 4 == 0]
    ratios = {}
    for length in (0, 6, 5, 4):
        counts = [Counter(), Counter()]
        for i in fit:
            counts[labels[i]].update({w[:length] if length else w for w in found[i]})
        c = [sum(x.values()) for x in counts]
        kinds = sum((e in counts[0]) + (e in counts[1]) for e in counts[0].keys() | counts[1].keys())
        for e in counts[0].keys() | counts[1].keys():
            n = [x[e] for x in counts]
            usual = sum(n) * c[1] / sum(c)
            if sum(n) < min_texts or not all(c) or abs(n[1] - usual) < min_deviation * math.sqrt(usual * c[0] / sum(c)):
                continue
            p = [max(n[y] - 0.75, 0) / c[y] + 0.75 * len(counts[y]) / c[y] * ((n[0] > 0) + (n[1] > 0)) / kinds for y in (0, 1)]
            ratios[length, e] = math.log(p[1]) - math.log(p[0])

    def total(i):
        return sum(next((ratios[k] for k in ((n, w[:n] if n else w) for n in (0, 6, 5, 4)) if k in ratios), 0.0)
                   for w in found[i])

    def row(i):
        n = max(1, len(found[i]))
        return [1, 10 * total(i) / n, total(i) / math.sqrt(n), math.log(n) / 5]

    w = toxicity.logistic(np.array([row(i) for i in apart]), np.array([float(labels[i]) for i in apart]))
    return {i: (total(i), 1 / (1 + math.exp(-float(np.dot(row(i), w))))) for i in found}


def made(n=600, seed=4):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("tal", "mir", "on", "sel") for b in ("a", "en", "ost", "ir", "umi")]
    rows, labels = [], {}
    for i in range(n):
        bad = i % 4 == 0
        text = [rng.choice(plain) for _ in range(rng.randrange(8, 60))] + [f"only{i}"]
        if bad:
            for _ in range(2 + len(text) // 20):
                text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(("", "s", "ing")))
        rows.append((i, " ".join(text)))
        if i % 5 != 3:
            labels[i] = int(bad)
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")


def test_query_against_brute_force(spark):
    rows, labels = made()
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs(spark, rows), table(spark, labels)).collect()}
    want = brute(rows, labels)
    assert set(got) == set(want)
    assert all(close(got[i].log_ratio, want[i][0]) and close(got[i].score, want[i][1], 1e-6) for i in got)
    assert all(got[i].held_out == (crc(i) % 5 == 0) and got[i].predicted == (got[i].score >= 0.5) for i in got)
    assert sum(got[i].predicted == (i % 4 == 0) for i in got) >= 0.97 * len(got)   # unlabelled and held-out ones too


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op13_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    away = [i for i in labels if crc(i) % 5 == 0]
    toxic = [i for i in away if labels[i]]
    assert sum(got[i].predicted for i in toxic) >= 0.9 * len(toxic)
    assert sum(got[i].predicted for i in away if not labels[i]) <= 0.01 * (len(away) - len(toxic))


def test_held_out_labels_and_copies_do_not_count(spark):
    rows, labels = made(300)
    turned = {i: 1 - y if crc(i) % 5 == 0 else y for i, y in labels.items()}
    copies = [(10_000 + k, rows[1][1]) for k in range(200)]      # unlabelled copies, then labelled like their original
    same = labels | {i: labels[1] for i, _ in copies}
    key = lambda got: sorted((r.doc_id, round(r.score, 9)) for r in got if r.doc_id < 10_000)
    a = key(toxicity.toxicity_scores(docs(spark, rows), table(spark, labels)).collect())
    assert a == key(toxicity.toxicity_scores(docs(spark, rows), table(spark, turned)).collect())
    assert a == key(toxicity.toxicity_scores(docs(spark, rows + copies), table(spark, same)).collect())


def test_sample_bound(spark):
    rows, labels = made(400)
    got = toxicity.toxicity_scores(docs(spark, rows), table(spark, labels), max_labelled=150)
    assert got.count() == 400
    from riskloom.llm.common import bounded_sample
    some = bounded_sample(spark.range(5000), "id", 700)
    assert some.count() == 700 and some.exceptAll(spark.range(5000)).isEmpty()
    assert sorted(some.collect()) == sorted(bounded_sample(spark.range(5000).repartition(7), "id", 700).collect())
    assert bounded_sample(spark.range(5), "id", 700).count() == 5


def test_odd_rows(spark):
    d = docs(spark, ODD)
    for labels in ([], [(1, 1), (2, 0), (2, 1), (4, None), (5, 0), (None, 1), (77, 0), (6, 3)], [(i, i % 2) for i in range(1, 11)]):
        got = toxicity.toxicity_scores(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert len({(r.score, r.log_ratio) for r in got if r.doc_id == 6}) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(d.limit(0), none).count() == 0
