import math
import random

import numpy as np

from riskloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, uid long, v string"


def brute(rows, k=5, every=50):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in ok]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(ok) if a != b)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **sizes):
    d = spark.createDataFrame([(i, v, 1, 1, 1, 1, "v") for i, v in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(d, "vec_id % 50 = 0", **sizes).collect()))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, topk.op8_exact_top_k(spark, sf).collect())) == brute(rows)


def test_blocks_ties_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (5 if j < 4 else 0.2) for j in range(40)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(50, rows[3][1])]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, query_rows=3, candidate_rows=37) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.5]), (50, [0.1]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [9.0, 9.0]),
            (5, []), (6, [1.0, -2.5, 4.0]), (0, [1.0, -2.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
    wide = [(0, [3e6, -2e6]), (1, [2.5e6, 1.0]), (2, [-3e6, 7.0])]
    assert run(spark, wide) == brute(wide)
