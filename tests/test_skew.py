import random

import pytest
from pyspark.sql import functions as F

from corpusmatch.operators.bounded import collect_in_blocks
from corpusmatch.operators.skew import keep_first, spread_join, top_k


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a third under NULL."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 50}") for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k string").cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows, small_rows", [(10, 0), (10_000, 0), (10, 100)])
def test_spread_join_is_a_join(spark, skewed, how, hot_rows, small_rows):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, v int")
    columns = ["id", "k", "v"] if how in ("inner", "left") else ["id", "k"]
    plain = skewed.join(right, "k", how).select(*columns).collect()
    spread = spread_join(skewed, right, "k", "id", how, hot_rows, small_rows).select(*columns).collect()
    assert sorted(spread, key=lambda r: r["id"]) == sorted(plain, key=lambda r: r["id"])


def test_spread_join_deals_out_hot_and_missing_keys(spark, skewed):
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(skewed, right, "k", "id", "left", hot_rows=20, small_rows=0)
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(r["count"] for r in per_task) < 1200


def test_many_tied_heavy_keys_lose_no_row(spark):
    left = spark.range(8000).selectExpr("id", "id % 400 as k").repartition(5)
    right = spark.range(400).selectExpr("id as k", "id * 2 as v")
    joined = spread_join(left, right, "k", "id", hot_rows=19, small_rows=0)
    assert joined.count() == 8000 and joined.filter("v <> 2 * k").count() == 0
    assert spread_join(left, right, "k", "id", "left_anti", hot_rows=19, small_rows=0).count() == 0


def test_keep_first(spark):
    rows = [(k, i % 7, i, None if i % 2 else "x") for k in [1, 2, None] for i in range(40)]
    df = spark.createDataFrame(rows, "k int, o int, id int, s string")
    got = {r["k"]: tuple(r) for r in keep_first(df, ["k"], F.col("o"), -F.col("id")).collect()}
    want = {k: min((r for r in rows if r[0] == k), key=lambda r: (r[1], -r[2])) for k in [1, 2, None]}
    assert got == want


def test_top_k_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 20) / 4, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "p string, score double, id int").repartition(5)
    got = sorted(map(tuple, top_k(df, "p", [F.desc("score"), F.asc("id")], 30, "id", slices=8).collect()))
    want = sorted(r for p in "ab" for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[1], r[2]))[:30])
    assert got == want


def test_blocks_stay_within_their_size(spark):
    df = spark.range(100).repartition(7)
    blocks = list(collect_in_blocks(df, F.lit(10), 95))
    assert sorted(r["id"] for b in blocks for r in b) == list(range(100))
    assert max(len(b) for b in blocks) == 9
    assert [len(b) for b in collect_in_blocks(df.limit(3), F.lit(10), 5)] == [1, 1, 1]
    assert list(collect_in_blocks(df.limit(0), F.lit(10), 5)) == []
