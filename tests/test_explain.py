"""Array expressions that work out each value once."""

from pyspark.sql import functions as F

from riskloom.operators import explain as X

NAMES = ["followers", "account_hour", "bio_length", "verified", "posts_per_day", "unknown"]
ROWS = [(1, [0.5, 1.5, -0.5, 0.0, 3.0, 0.5], 0.0), (2, [0.0] * 6, 7.0), (3, [-1.0, 4.0, None, -1.0, 0.25, 2.0], None)]


def frame(spark):
    df = spark.createDataFrame(ROWS, "id long, v array<double>, bio_length double")
    return df.withColumn("a", F.transform(F.arrays_zip(F.array(*map(F.lit, NAMES)).alias("name"), F.col("v").alias("value")),
                                          lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))))


def ranked(values, weigh, k):
    order = sorted(range(6), key=lambda i: (-abs(values[i]) * (weigh(NAMES[i])), i))
    return [(NAMES[i], values[i]) for i in order[:k]]


def test_top_entries_keep_the_order_of_ties(spark):
    df = frame(spark).where("id < 3")
    est = lambda n: 0.3 if n in X.ESTIMATED_FEATURES else 1.0
    got = {r.id: r for r in df.select("id", X.top_k_abs(F.col("a"), 4).alias("t"), X.rank_estimated(F.col("a"), 4).alias("r")).collect()}
    for i, values, _ in ROWS[:2]:
        assert [tuple(x) for x in got[i].t] == ranked(values, lambda n: 1.0, 4)
        assert [tuple(x) for x in got[i].r] == ranked(values, est, 4)


def test_annotations(spark):
    df = frame(spark)
    ann = {r.id: {x.raw_name: x for x in r.n} for r in df.select("id", X.annotate(F.col("a"), X.raw_value_map(df)).alias("n")).collect()}
    one = ann[1]
    assert one["bio_length"].description == X.FEATURE_DESCRIPTIONS_ZERO["bio_length"]
    assert one["bio_length"].direction == "increases_fake" and one["bio_length"].signed_pct == 8.3
    assert one["verified"].direction == "decreases_fake" and one["unknown"].description == "unknown"
    assert one["account_hour"].pct == 25.0 and one["account_hour"].estimated and not one["followers"].estimated
    assert ann[2]["bio_length"].description == X.FEATURE_DESCRIPTIONS["bio_length"] and ann[2]["followers"].pct == 0.0
    assert ann[3]["followers"].pct is None                       # a null value leaves no total


def test_the_total_is_not_summed_again_for_each_entry_nor_weights_for_each_comparison(spark):
    df = frame(spark)
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(X.annotate(F.col("a"), X.raw_value_map(df))).count("aggregate(") <= 2
    assert plan(X.rank_estimated(F.col("a"), 4)).count("array_contains(") == 1


def test_back_projection_adds_loadings_in_order_outside_lambdas(spark):
    import math
    V = [[0.1, -0.7, 3.0], [1e-3, 0.3, -2.0]]
    rows = [(1, [0.5, -1.25]), (2, [None, 2.0]), (3, None), (4, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, c array<double>")
    out = df.select("id", X.back_project(F.col("c"), V, ["a", "b", "c"]).alias("p"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    got = {r.id: [(x.name, x.value) for x in r.p] for r in out.collect()}
    for i, c in rows[:3]:
        c = [x or 0.0 for x in c or [0.0, 0.0]]
        assert got[i] == [(n, 0.0 + c[0] * V[0][j] + c[1] * V[1][j]) for j, n in enumerate("abc")]
    assert all(math.isnan(v) for _, v in got[4])


def test_weights_without_nulls_are_sorted_without_a_comparator(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [nan, 1.0, nan, 2.0, -2.0, 0.0]), (2, [3.0, None, 1.0, 4.0, -4.0, None])], "id long, v array<double>")
    df = df.withColumn("a", F.transform("v", lambda v, i: F.struct(F.concat(F.lit("n"), i).alias("name"), v.alias("value"))))
    out = df.select("id", X.top_k_abs(F.col("a"), 5).alias("t"))
    assert "sort_array(" in out._jdf.queryExecution().analyzed().toString()
    got = {r.id: [x.name for x in r.t] for r in out.collect()}
    assert got[1] == ["n0", "n2", "n3", "n4", "n1"]
    keyed = F.transform("a", lambda x, i: F.struct(x["name"].alias("name"), i.alias("i"), F.abs(x["value"]).alias("w")))
    cmp = lambda l, r: F.when(l["w"] > r["w"], F.lit(-1)).when(l["w"] < r["w"], F.lit(1)).otherwise(l["i"] - r["i"])
    assert got[2] == df.where("id = 2").select(F.slice(F.transform(F.array_sort(keyed, cmp), lambda x: x["name"]), 1, 5)).first()[0]
