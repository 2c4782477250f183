import uuid
from datetime import datetime

from pyspark.sql import functions as F

from gatewarden.functions.scalars import (
    ENTITY_NAMESPACE, as_of_lit, clean_email, clean_name, entity_id, erp_key, half_even, iso_timestamp, whole_days,
)


def test_entity_id_equals_uuid5(spark):
    keys = [f"k{i}/é:{i * 7}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", entity_id("okta", F.col("k")).alias("id"))
    for row in df.collect():
        assert row["id"] == str(uuid.uuid5(ENTITY_NAMESPACE, f"okta:{row['k']}"))


def test_whole_days_floor(spark):
    df = spark.createDataFrame(
        [(datetime(2000, 1, 2, 12),), (datetime(2000, 1, 4, 11),), (datetime(2000, 1, 4, 13),)], "t timestamp"
    )
    out = [r[0] for r in df.select(whole_days(as_of_lit("2000-01-03 12:00:00"), F.col("t"))).collect()]
    assert out == [1, -1, -2]


def test_names_collapse_double_spaces_once(spark):
    df = spark.createDataFrame([(" Ann    Lee ", " A@B.c "), ("  ", None)], "n string, m string")
    got = df.select(clean_name(F.col("n")), clean_email(F.col("m"))).collect()
    assert tuple(got[0]) == ("ann  lee", "a@b.c")
    assert tuple(got[1]) == (None, None)


def test_erp_key_times_and_rounding(spark):
    row = spark.range(1).select(
        erp_key(F.lit("netsuite:TRAN_X.full")),
        iso_timestamp(F.lit("2024-01-02T03:04:05Z")) == iso_timestamp(F.lit("2024-01-02T03:04:05")),
        iso_timestamp(F.lit("yesterday")),
        half_even(F.lit(0.125), 2),
    ).first()
    assert tuple(row) == ("TRAN_X", True, None, 0.12)
