import pytest
from pyspark.sql import functions as F

from riftline.operators import joins
from riftline import schemas
from riftline.operators.clean import clean_dataset
from riftline.plans.changes import build_changes, merge_changes
from riftline.session import freeze
from riftline.sources import tables as S


def test_commit_parent(frame):
    out = joins.commit_parent(frame([(0, "c"), (1, "b"), (2, "a")], "seq long, hash string"))
    assert {r.hash: r.parent for r in out.collect()} == {"c": "b", "b": "a", "a": None}


def test_metric_delta(frame):
    schema = "hash string, file string, class string, m double"
    now = frame([("h", "f", "known", 5.0), ("h", "f", "hole", 5.0), ("h", "f", "new", 5.0)], schema)
    old = frame([("h", "f", "known", 2.0), ("h", "f", "hole", None), ("h", "f", "gone", 1.0)], schema)
    out = joins.metric_delta(now, old, keys=["hash", "file", "class"], metrics=["m"])
    assert {r["class"]: r.d_m for r in out.collect()} == {"known": 3.0, "hole": None, "new": 5.0}


def test_class_status(frame):
    now, old = frame([("a",), ("b",)], "class string"), frame([("b",), ("c",)], "class string")
    out = joins.class_status(now, old, keys=["class"]).collect()
    assert {tuple(r) for r in out} == {("a", "new"), ("b", "modified")}
    every = joins.class_status(now, old, keys=["class"], include_deleted=True).collect()
    assert {tuple(r) for r in every} == {("a", "new"), ("b", "modified"), ("c", "deleted")}


def test_hot_join_equals_join(spark):
    rows = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    other = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = joins.split_hot_join(rows, other, on=["k"], how=how, hot_rows=100)
        want = rows.join(other, "k", how)
        assert got.exceptAll(want.select(got.columns)).count() == 0
        assert got.count() == want.count()


METRICS = [
    ("h2", "src/A.java", "A", 5.0), ("h1", "src/A.java", "A", 3.0), ("h2", "src/A.java", "B", 7.0),
    ("h2", "src/New.java", "N", 4.0), ("h1", "src/Gone.java", "G", 9.0), ("h2", "src/ATest.java", "T", 1.0),
    ("h1", "src/ATest.java", "T", 1.0), ("h0", "src/A.java", "A", 1.0),
]


@pytest.fixture
def project(frame):
    commits = frame(
        [("h2", "['src/A.java', 'src/New.java', 'src/Gone.java', 'src/ATest.java']", True),
         ("h2", "['src/A.java', 'src/New.java', 'src/Gone.java', 'src/ATest.java']", True),
         ("h0", "['src/A.java']", False), ("unknown", "['src/A.java']", False)],
        "hash string, fileschanged string, contains_bug boolean",
    )
    history = frame([(0, "h2"), (1, "h1"), (2, "h0")], "seq long, hash string")
    return commits, history, frame(METRICS + METRICS[:1], "hash string, file string, class string, m double")


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_merge_changes(project, hot_rows):
    out = merge_changes(*project, metric_names=["m"], hot_rows=hot_rows).collect()
    assert {(r.hash, r["class"], r.m, r.d_m, r.contains_bug) for r in out} == {("h2", "A", 5.0, 2.0, True), ("h2", "B", 7.0, 7.0, True)}
    assert len(out) == 2
    zero = merge_changes(*project, metric_names=["m"], missing_file="zero", hot_rows=hot_rows).collect()
    assert {(r.file, r["class"], r.d_m) for r in zero} == {
        ("src/A.java", "A", 2.0), ("src/A.java", "B", 7.0), ("src/New.java", "N", 4.0), ("src/Gone.java", "0", 0.0)
    }


def test_explode_left_keeps_unmatched(frame):
    commits = frame([("h", ["f"]), ("g", [])], "hash string, files array<string>")
    metrics = frame([("f", 1), ("x", 2)], "file string, m int")
    out = joins.explode_left_join(commits, metrics, files="files", file="file").collect()
    assert {(r.file, r.m, r.hash) for r in out} == {("f", 1, "h"), ("x", 2, None)}


def test_pending(frame):
    todo = frame([("c",), ("b",)], "hash string")
    parents = frame([("c", "b"), ("b", "a"), ("a", None)], "hash string, parent string")
    done = frame([("b",)], "hash string")
    out = S.pending_with_parents(todo, parents, done, key="hash")
    assert sorted(r.hash for r in out.collect()) == ["c"]


def test_change_table_and_default_clean(spark, frame):
    commits = frame(
        [("c2", 1_704_067_200, "['A.java', 'B.java']", True, False, None, 3.0, 8.0, 2.0, 4.0, 1.0, 5.0, 6.0, 7.0, 0.5),
         ("c1", 1_703_980_800, "['A.java']", False, False, None, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.1)],
        schemas.COMMITS,
    )
    history = frame([(0, "c2"), (1, "c1")], "seq long, hash string")
    metrics = frame(
        [(file, name, "class", *[float(n + shift) for n in range(49)], commit) for commit, file, name, shift in (
            ("c1", "A.java", "A", 0), ("c2", "A.java", "A", 2), ("c1", "B.java", "B", 1), ("c2", "B.java", "B", 1))],
        schemas.CLASS_METRICS,
    )
    table = build_changes(commits, history, metrics)
    assert table.columns == schemas.change_columns() and len(table.columns) == 126
    rows = {r["class"]: r for r in table.collect()}
    assert set(rows) == {"A", "B"}
    a = rows["A"]
    assert (a.cbo, a.d_cbo, a.time_of_day, a.day_of_week, a.is_weekend) == (2.0, 2.0, 0, 0, False)
    assert (a.net_lines_changed, a.absolute_lines_changed, a.lines_per_file) == (6.0, 10.0, 5.0)
    assert (a.author_experience, a.author_ownership, a.changed_file_count, a.num_files_changed, a.entropy_bucket) == (5.0, 4.0, 2, 2, "high")
    kept = clean_dataset(freeze(table))  # no argument is needed
    assert kept.columns == table.columns and {r["class"] for r in kept.collect()} <= {"A", "B"}


def test_every_hot_key_is_sliced(spark):
    rows = spark.range(6000).select((F.col("id") % 2000).alias("k"), F.lit(1).alias("same"))
    assert joins.hot_keys(rows, on=["k"], hot_rows=2).count() == 2000
    other = spark.range(2000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    assert joins.split_hot_join(rows, other, on=["k"], hot_rows=2).count() == 6000


def test_hot_slices_are_pinned(frame):
    """A task that runs again must not deal the rows of a hot key to other slices."""
    rows = frame([("a", i) for i in range(50)] + [("b", 1)], "k string, n int").repartition(4, "n")
    joined = joins.split_hot_join(rows, frame([("a", 7), ("b", 8)], "k string, m int"), on=["k"], hot_rows=10)
    assert "monotonically" not in joined._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in joined.select("k", "n", "m").collect()) == sorted([("a", i, 7) for i in range(50)] + [("b", 1, 8)])
