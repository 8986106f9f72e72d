"""Physical-plan checks: pushdown, no shuffle in row-local steps, top-k pre-trim."""

from pyspark.sql import functions as F

from riskloom.operators import graph as G
from riskloom.operators.features import metadata_features
from riskloom.plans.common import acc
from riskloom.sources.tables import Tables

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_projection_is_narrow_and_jvm_side(spark):
    c = Tables(spark, SF_SMALL).customer.select(F.col("c_custkey").alias("account_id"),
                                                F.col("c_name").alias("username"),
                                                F.col("c_acctbal").alias("followers"))
    p = _plan(metadata_features(c))
    assert "Exchange" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    o = Tables(spark, SF_SMALL).orders
    df = o.where(F.col("o_custkey") == 5).select("o_orderkey")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,5)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p


def test_tier_sample_uses_window_group_limit(spark):
    t = G.follower_tiers(acc(spark, SF_SMALL))
    p = _plan(G.sample_per_tier(G.peer_pairs(t)))
    assert "WindowGroupLimit" in p


def test_accounts_joins_aggregate_before_joining(spark):
    p = _plan(acc(spark, SF_SMALL))
    # lineitem is partially aggregated per order before any join
    assert "HashAggregate(keys=[l_orderkey" in p
