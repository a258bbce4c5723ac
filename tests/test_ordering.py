import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riftline.operators import ordering
from riftline.operators.ordering import (
    hash_rank,
    running_totals,
    split_at_rank,
    with_global_index,
    with_group_index,
    with_next,
)


@pytest.fixture
def events(spark):
    """A third of the rows share one group and one time."""
    g = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17)
    t = F.when(F.col("id") % 3 == 0, 5).otherwise(F.xxhash64("id") % 1000)
    return spark.range(6000).select("id", g.alias("g"), t.alias("t"), (F.col("id") % 11).alias("v")).repartition(13)


@pytest.mark.parametrize("parts", [1, 8])
def test_global_index(events, spark, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    try:
        got = with_global_index(events, ["t", "id"])
        want = F.row_number().over(Window.orderBy("t", "id")) - 1
        assert got.withColumn("w", want).filter("w <> i").count() == 0
        grouped = with_group_index(events, ["g"], ["t", "id"])
        want = F.row_number().over(Window.partitionBy("g").orderBy("t", "id")) - 1
        assert grouped.withColumn("w", want).filter("w <> i").count() == 0
        totals = running_totals(events, ["t", "id"], {"s": F.col("v")})
        assert totals.withColumn("w", F.sum("v").over(Window.orderBy("t", "id"))).filter("w <> s").count() == 0
        ahead = with_next(events, by=["g"], order=["t", "id"], values={"n": F.col("v")})
        want = F.lead("v").over(Window.partitionBy("g").orderBy("t", "id"))
        assert ahead.withColumn("w", want).filter("NOT (w <=> n)").count() == 0
        assert totals.count() == grouped.count() == ahead.count() == got.count() == 6000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("few", [10, 10_000])
@pytest.mark.parametrize("k", [0, 1, 2500, 5999])
def test_split_at_rank(events, monkeypatch, k, few):
    monkeypatch.setattr(ordering, "_FEW", few)
    assert events.filter(split_at_rank(events, ["t", "id"], k)).count() == 6000 - k


def test_split_needs_integers(events):
    with pytest.raises(TypeError):
        split_at_rank(events.withColumn("s", F.col("id").cast("string")), ["s"], 3)


def test_hash_rank(events):
    drawn = events.withColumn("h", F.xxhash64("id"))
    got = hash_rank(drawn, "h", "id", ["g"])
    want = F.row_number().over(Window.partitionBy("g").orderBy("h", "id")) - 1
    assert got.withColumn("w", want).filter("w <> rank").count() == 0
    assert got.count() == 6000
