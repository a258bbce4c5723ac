import pytest
from pyspark.sql import functions as F

from riftline.operators import profile, scale, split


@pytest.fixture
def days(spark):
    def build(n):
        return spark.range(n).select(
            "id", F.timestamp_seconds(F.col("id") * 86400).alias("ts"), (F.col("id") * 1.0).alias("x"),
            (F.col("id") % 2).alias("y"), F.lit(3.0).alias("flat"),
        )

    return build


def test_date_split(days):
    out = split.split_by_date(days(9), ts="ts", tie="id")
    assert [r.id for r in out.filter("is_test").orderBy("id").collect()] == [7, 8]
    named = split.split_by_date(days(9).withColumn("key", F.col("id").cast("string")), ts="ts", tie="key")
    assert [r.id for r in named.filter("is_test").orderBy("id").collect()] == [7, 8]


def test_random_split_is_exact_and_stable(days):
    a = split.split_random(days(101), key="id").filter("is_test")
    b = split.split_random(days(101).repartition(5), key="id").filter("is_test")
    assert a.count() == 21 and {r.id for r in a.collect()} == {r.id for r in b.collect()}


def test_scaling(days):
    train, test = scale.minmax_scale(days(5), days(7), cols=["x", "flat"])
    assert [r.x for r in train.orderBy("id").collect()] == [0, 0.25, 0.5, 0.75, 1]
    assert test.agg(F.max("x"), F.max("flat")).first()[:] == (1.5, 0.0)
    (z,) = scale.standard_scale(days(5), cols=["x", "flat"])
    assert z.agg(F.avg("x"), F.stddev_pop("x"), F.max("flat")).first()[:] == pytest.approx((0, 1, 0))


@pytest.mark.parametrize("block", [3, 4, 100])
def test_windows(days, block):
    out = split.sliding_windows(days(11), order=["ts", "id"], cols=["x"], label="y", size=3, block=block).orderBy("i").collect()
    assert [r.i for r in out] == list(range(2, 11))
    assert all(r.sequence == [[r.i - 2.0], [r.i - 1.0], [float(r.i)]] and r.label == r.i % 2 for r in out)


def test_folds(days):
    out = split.expanding_folds(days(60), order=["ts", "id"], k=5)
    tests = out.filter("role = 'test'").groupBy("fold").agg(F.min("i"), F.max("i"), F.count("*")).orderBy("fold").collect()
    assert [tuple(r) for r in tests] == [(n, 10 * n + 10, 10 * n + 19, 10) for n in range(5)]
    assert out.filter("role = 'train' AND fold = 4").count() == 50
    with pytest.raises(ValueError):
        split.expanding_folds(days(59), order=["ts", "id"], k=5)
    dealt = split.stratified_folds(days(100), label="y", key="id", k=5)
    assert {r["count"] for r in dealt.groupBy("y", "fold").count().collect()} == {10}


def test_weights(frame):
    df = frame([(0,), (0,), (0,), (1,)], "y int")
    assert {r.y: r.weight for r in split.balanced_class_weights(df, label="y").collect()} == pytest.approx({0: 4 / 6, 1: 2.0})
    assert split.pos_weight_ratio(df, label="y").first()[0] == 3


def test_profiles(frame):
    df = frame([("a", 1.0), ("a", None), ("a", 5.0), ("b", 2.0)], "k string, v double")
    assert profile.sum_over_count(df, key=["k"], cols=["v"]).orderBy("k").first().v == 2.0
    assert [tuple(r) for r in profile.null_profile(df).collect()] == [("v", 1)]
    summary = profile.group_size_summary(df, key=["k"]).first()
    assert tuple(summary) == (2, 2.0, pytest.approx(2**0.5), 1, 1.5, 2.0, 2.5, 3)
    bins = profile.histogram(frame([(float(n),) for n in range(11)], "x double"), col="x", bins=5).orderBy("bin").collect()
    assert [r.n for r in bins] == [2, 2, 2, 2, 3]
    assert profile.mean_frequency(df, col="k").first()[0] == 2.0
