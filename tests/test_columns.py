import datetime as dt

import pytest
from pyspark.sql import functions as F

from riftline import schemas
from riftline.functions import columns as C
from riftline.functions.folds import nan_to_null
from riftline.operators import rows


def one(frame, value, kind, column):
    return frame([(value,)], f"v {kind}").select(column(F.col("v")).alias("out")).first().out


def test_fixed_lists():
    assert len(schemas.METRICS) == 49
    assert len(schemas.main_features()) == 93
    assert len(schemas.change_columns()) == 126
    assert len(schemas.CLASS_METRICS) == 53


def test_split_delimited(frame):
    text = ",CAS_DELIMITERa.java,"
    assert one(frame, text, "string", lambda c: C.split_delimited(c, sep="CAS_DELIMITER", drop_empty=False)) == ["", "a.java"]
    assert one(frame, text, "string", lambda c: C.split_delimited(c, sep="CAS_DELIMITER")) == ["a.java"]


@pytest.mark.parametrize("text,want", [("[]", [""]), ("['a']", ["a"]), ("['a', 'b']", ["a", "b"])])
def test_parse_list_string(frame, text, want):
    assert one(frame, text, "string", C.parse_list_string) == want


def test_normalize_path(frame):
    text = "/home/x/repo_worker_3\\src\\A.java"
    assert one(frame, text, "string", lambda c: C.normalize_path(c, prefix=r"^/home/x/repo(_worker_)?[0-9]*\\")) == "src/A.java"


def test_source_file_filter(frame):
    paths = ["a/B.java", "a/package-info.java", "a/BTest.java", "Example/B.java", "a/B.txt"]
    df = frame([(p,) for p in paths], "file string")
    assert [r.file for r in rows.source_file_filter(df, col="file").collect()] == ["a/B.java"]


def test_calendar(frame):
    df = frame([(dt.datetime(2024, 1, 1, 7),), (dt.datetime(2024, 1, 6),)], "ts timestamp")
    out = df.select(*[c.alias(n) for n, c in C.calendar_features(F.col("ts")).items()]).collect()
    assert [tuple(r) for r in out] == [(7, 0, False), (0, 5, True)]


@pytest.mark.parametrize(
    "values,want",
    [([0, 1, 2, 3], ["low", "low", "medium", "high"]), ([2, 2], ["medium", "medium"]), ([0, None, 3], ["low", None, "high"])],
)
def test_bucket(frame, values, want):
    df = frame([(n, float(v) if v is not None else None) for n, v in enumerate(values)], "i int, x double")
    out = rows.equal_width_bucket(df, col="x", out="b").orderBy("i").collect()
    assert [r.b for r in out] == want


def test_changed_file_count(frame):
    assert one(frame, "a,b,c", "string", C.changed_file_count) == 3


def test_fill_and_sparse(frame):
    df = frame([(None, None, "x"), (1.0, 2, None)], "a double, b int, c string")
    assert [tuple(r) for r in rows.fill_missing(df, -1).collect()] == [(-1.0, -1, "x"), (1.0, 2, "-1")]
    assert rows.drop_sparse_rows(df, max_nulls=1).count() == 1
    assert [r.n_null for r in rows.null_count_row(df).collect()] == [2, 1]


def test_nan_is_missing(frame):
    df = nan_to_null(frame([(float("nan"),), (1.0,)], "`lcom*` double"))
    assert [r[0] for r in df.collect()] == [None, 1.0]


def test_derived_columns(frame):
    df = frame([(1,)], "a int")
    out = rows.derived_columns(df, {"b": lambda t: t["a"] + 1, "c": lambda t: t["b"] * 2})
    assert tuple(out.first()) == (1, 2, 4)
    with pytest.raises(ValueError):
        rows.derived_columns(df, {"b": 3})


def test_sample_survives_repartitioning(spark):
    df = spark.range(5000)
    for exact in (True, False):
        a = rows.sample_fraction(df, key="id", fraction=0.2, exact=exact)
        b = rows.sample_fraction(df.repartition(7), key="id", fraction=0.2, exact=exact)
        assert {r.id for r in a.collect()} == {r.id for r in b.collect()}
        assert a.count() == 1000 if exact else 850 < a.count() < 1150
