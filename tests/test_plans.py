import random

import pytest
from pyspark.sql import functions as F

from gatewarden.plans.durable import materialize, materialize_with, release
from gatewarden.plans.joins import HOT_KEY_DIVISOR, fits_broadcast, hot_keys, skew_join
from gatewarden.plans.ranking import hashed_rank


def tables(spark):
    rnd = random.Random(3)
    big = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(400)}") for i in range(3000)]
    big += [(9000 + i, None) for i in range(50)]
    small = [("hot", 1), ("hot", 2)] + [(f"k{i}", i) for i in range(0, 400, 2)]
    return (
        spark.createDataFrame(big, "i int, k string"),
        spark.createDataFrame(small, "k string, v int"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    big, small = tables(spark)
    plain = big.join(small, "k", how)
    salted = skew_join(big, small, "k", how, force_salting=True)
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_are_few_and_right(spark):
    big, _ = tables(spark)
    found = [r["k"] for r in hot_keys(big.where("k is not null"), ["k"]).collect()]
    assert "hot" in found and len(found) <= HOT_KEY_DIVISOR


def test_broadcast_only_below_the_limit(spark):
    small = materialize(spark.range(10), "t")
    assert fits_broadcast(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not fits_broadcast(small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_tables_report_measures(spark):
    stored, seen = materialize_with(spark.range(7), "t", {"n": F.count(F.lit(1))})
    assert seen == {"n": 7} and stored.count() == 7
    release(stored)
    with pytest.raises(Exception):
        stored.count()


def test_hashed_rank_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("i"), (F.col("id") % 3 == 0).alias("g"))
    out = hashed_rank(df, "i", 5, ["g"]).collect()
    for group in (True, False):
        places = sorted(r["place"] for r in out if r["g"] == group)
        assert places == list(range(1, len(places) + 1))
        assert all(r["group_size"] == len(places) for r in out if r["g"] == group)
    again = {r["i"]: r["place"] for r in hashed_rank(df, "i", 5, ["g"]).collect()}
    assert again == {r["i"]: r["place"] for r in out}
