import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftline.operators import clean, clusters
from riftline.operators.clusters import cluster_aggregate, rule_cluster_reduce


def kept(df):
    return [r[0] for r in df.orderBy("i").select("i").collect()]


@pytest.mark.parametrize(
    "rule,schema,rows,want",
    [
        (clean.rule_has_members, "totalMethodsQty double, totalFieldsQty double", [(None, None), (1, None), (0, 0)], [1]),
        (clean.rule_no_lines_added, "la double", [(None,), (0,), (2,)], [2]),
        (clean.rule_accessor_only, "totalMethodsQty double, wmc double, rfc double", [(1, 1, None), (1, 1, 1), (0, 1, 1)], [0, 2]),
        (clean.rule_dead_code, "cbo double, fanin double", [(0, None), (0, 0), (1, None)], [0, 2]),
        (clean.rule_data_class, "wmc double, rfc double, totalFieldsQty double", [(1, 1, None), (1, 1, 1)], [0]),
        (clean.rule_no_churn, "la double, ld double", [(0, None), (0, 0)], [0]),
        (clean.rule_comment_only, "d_a double, d_b double", [(0, None), (0, 0), (1, 0)], [0, 2]),
        (clean.rule_trivial_method_change, "la double, ld double, d_totalMethodsQty double", [(2, 1, None), (2, 1, 0), (9, 9, 1), (None, 1, 1)], [1, 2, 3]),
        (clean.rule_name_suffix, "file string", [("lib-1.0/FooType.java",), ("src/FooType.java",), ("aException.x",), ("b.Type",)], [0, 3]),
        (clean.rule_change_too_large, "d_a double, d_b double, contains_bug boolean", [(-200, 100, None), (-200, None, False), (-200, 100, True)], [1, 2]),
        (clean.rule_change_too_small, "d_a double, contains_bug boolean", [(1, False), (1, True), (-20, None)], [1, 2]),
        (clean.rule_too_many_files, "changed_file_count double, contains_bug boolean", [(11, False), (11, True), (None, False), (10, False)], [1, 3]),
    ],
)
def test_row_rules(frame, rule, schema, rows, want):
    data = [(n, *[float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r]) for n, r in enumerate(rows)]
    df = frame(data, f"i int, {schema}")
    out = rule(df)
    assert kept(out) == want
    assert kept(rule(out)) == want
    assert kept(rule(df.repartition(3))) == want
    lacking = frame([(1,)], "i int")
    if rule is not clean.rule_too_many_files:
        assert rule(lacking) is lacking


DAY = dt.timedelta(days=1)
END = dt.datetime(2024, 6, 1)


def test_recent_clean_last(frame):
    rows = [
        (0, "a", END - 27 * DAY, False), (1, "b", END - 28 * DAY, False), (2, "c", END, True), (3, None, END, False),
        (4, "d", END - DAY, None), (5, "a", END - 40 * DAY, False), (6, "e", None, False),
    ]
    df = frame(rows, "i int, class string, author_date_unix_timestamp timestamp, contains_bug boolean")
    assert kept(clean.rule_recent_clean_last(df, tie=["i"])) == [1, 2, 3, 4, 5, 6]
    named = df.withColumn("project", F.lit("p"))
    assert kept(clean.rule_recent_clean_last(named, project="project", tie=["i"])) == [1, 2, 3, 4, 5, 6]


def test_deleted_soon(frame):
    rows = [
        (0, "a", END, "x"), (1, "a", END + DAY, "Deleted"), (2, "b", END, "x"), (3, "b", END + 3 * DAY, "deleted"),
        (4, None, END, "x"), (5, None, END, "deleted"), (6, "c", END, "x"),
    ]
    df = frame(rows, "i int, class string, author_date_unix_timestamp timestamp, type string")
    assert kept(clean.rule_deleted_soon(df, tie=["i"])) == [1, 2, 3, 4, 5, 6]


def test_dedupe_counts_nan_as_missing(frame):
    df = frame([(1, float("nan")), (1, None), (2, 1.0)], "i int, x double")
    assert clean.rule_dedupe(df).count() == 2


def test_dataset_chain_counts(frame):
    df = frame([(0, 0.0, 1.0), (1, 2.0, 0.0), (1, 2.0, 0.0)], "i int, la double, ld double")
    config = clean.CleanConfig(rules=(0, 5, 11))
    assert kept(clean.clean_dataset(df, config=config)) == [1]
    steps = clean.clean_counts(df, config=config).orderBy("step").collect()
    assert [tuple(r) for r in steps] == [(0, None, 3, None), (1, 0, 2, 1), (2, 5, 1, 1), (3, 11, 1, 0)]


def commits(frame, counts):
    rows, n = [], 0
    for commit, (files, size) in counts.items():
        for at in range(size):
            rows.append((n, commit, files, float(at % 3) * 10, float(at), at % 2 == 0, at % 4 == 0))
            n += 1
    return frame(rows, "id int, hash string, changed_file_count double, x double, y double, contains_bug boolean, fix boolean")


OPTIONS = {"features": ["x", "y", "changed_file_count"], "info": ["id"], "tie": ["id"]}


def test_cluster_reduce(frame):
    df = commits(frame, {"small": (2.0, 1), "also": (3.0, 1), "big": (20.0, 9), "few": (20.0, 2), "gone": (None, 3)})
    out = rule_cluster_reduce(df, **OPTIONS)
    sizes = {r.hash: r["count"] for r in out.groupBy("hash").count().collect()}
    assert sizes == {"small": 1, "also": 1, "big": 2, "few": 2}
    assert out.columns == df.columns


def test_cluster_size_without_small_commits(frame):
    out = rule_cluster_reduce(commits(frame, {"big": (20.0, 9)}), **OPTIONS)
    row = out.first()
    assert out.count() == 1 and row.y == 4.0 and row.contains_bug and row.fix == pytest.approx(3 / 9)


def test_hot_commits_cluster_alike(frame):
    df = commits(frame, {"small": (4.0, 4), "big": (20.0, 60), "other": (30.0, 41)})
    local = rule_cluster_reduce(df, **OPTIONS)
    spread = rule_cluster_reduce(df, group_rows=5, **OPTIONS)

    def shape(out):
        return sorted((r.hash, round(r.x, 6), round(r.y, 6), r.id, r.contains_bug) for r in out.collect())

    assert shape(local) == shape(spread)


def test_cluster_aggregate_skips_missing(frame):
    df = frame(
        [(0, "h", 1, None, 1.0, True), (1, "h", 1, "t", 3.0, False), (2, "h", 2, "u", None, False)],
        "i int, hash string, c int, type string, x double, contains_bug boolean",
    )
    out = cluster_aggregate(df, keys=["hash"], cluster="c", features=["x"], info=["i", "type"], order=["i"])
    assert sorted((r.i, r.type, r.x, r.contains_bug) for r in out.collect()) == [(0, "t", 2.0, True), (2, "u", None, False)]


def test_counts_share_passes(frame):
    """The counts of single-row rules come from one pass and equal the rows each rule leaves."""
    rows = [
        (n, "p", f"src/{'UserType' if n % 7 == 0 else 'A'}.java", f"C{n % 5}", "class", None if n % 4 == 0 else n % 3 == 0,
         1_700_000_000 + n * 3600, None if n % 6 == 0 else float(n % 5), float(n % 2), float(n % 4), float(n % 3), float(n % 3))
        for n in [*range(60), *range(10)]
    ]
    df = frame(rows, "hash int, project string, file string, class string, type string, contains_bug boolean, "
                     "author_date_unix_timestamp long, la double, ld double, wmc double, rfc double, totalFieldsQty double")
    df = df.withColumn("author_date_unix_timestamp", F.timestamp_seconds("author_date_unix_timestamp"))
    for rules in ((0, 2, 3, 5, 8, 10, 11), (5, 0, 8, 11), (), (8, 5)):
        config = clean.CleanConfig(rules=rules, project="project", gap_recent=2 * 3600)
        steps, table, want = clean._steps(config, df.columns), df, [(0, None, 70, None)]
        for at, number in enumerate(rules, 1):
            table = steps[number](table)
            n = table.count()
            want.append((at, number, n, want[-1][2] - n))
        got = clean.clean_counts(df, config=config)
        assert [tuple(r) for r in got.orderBy("step").collect()] == want
    wide = clean.clean_counts(df, config=clean.CleanConfig(rules=(3, 4, 5, 8, 10, 11), project="project"))
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # one pass


def test_rows_are_dealt_by_their_number(frame, monkeypatch):
    """Twice the rows, twice the tasks for the rules that hold whole rows; the rows kept are the same."""
    monkeypatch.setattr(clean, "ROWS_PER_TASK", 20)
    config = clean.CleanConfig(rules=(0, 2), project="project", tie=("hash", "file"))
    schema = "project string, hash int, file string, class string, author_date_unix_timestamp timestamp, contains_bug boolean"
    day = dt.datetime(2020, 1, 1)

    def table(n):
        rows = [("p", i, "f", None if i % 7 == 0 else f"c{i % 9}", day + dt.timedelta(days=i), i % 5 == 0) for i in range(n)]
        return frame([*rows, *rows[:10]], schema)

    def parts(n):
        return clean._spread(table(n), config).rdd.getNumPartitions()

    assert (parts(5), parts(90), parts(190)) == (table(5).rdd.getNumPartitions(), 5, 10)
    spread = kept_rows(clean.clean_dataset(table(90), config=config))
    monkeypatch.setattr(clean, "ROWS_PER_TASK", 1_000)
    assert spread == kept_rows(clean.clean_dataset(table(90), config=config)) and len(spread) < 90


def kept_rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_many_groups_cluster_as_one_by_one():
    draw = np.random.default_rng(4)
    k = draw.integers(1, 7, 400)
    size = k + draw.integers(0, 30, len(k))
    first = np.r_[0, np.cumsum(size)]
    points = draw.integers(-3, 4, (first[-1], 3)).astype(float)
    want = [clusters.lloyd(points[a:b], n) for a, b, n in zip(first, first[1:], k)]
    assert np.array_equal(clusters.lloyd_groups(points, first, k), np.concatenate(want))


def test_small_commits_share_a_call(frame, monkeypatch):
    """Commits are clustered many at a time, beside values out of range; rows without a commit go, as before."""
    rows = [(n, None if n % 40 < 9 else f"c{n % 40}", 20.0, float(n % 7), float(n // 80)) for n in range(800)]
    rows += [(n, "odd", 20.0, float("inf") if n % 2 else 1.0, 1e200) for n in range(800, 820)] + [(900, "small", 3.0, 0.0, 0.0)]
    df = frame(rows, "id int, hash string, changed_file_count double, x double, y double").withColumn("contains_bug", F.lit(True))
    out = rule_cluster_reduce(df, **OPTIONS).groupBy("hash").count().collect()
    assert {r.hash: r["count"] for r in out if r.hash != "odd"} == {**{f"c{n}": 3 for n in range(9, 40)}, "small": 1}
    calls = []
    monkeypatch.setattr(clusters, "lloyd", lambda points, k, rounds: calls.append(1) or np.zeros(len(points), dtype=int))

    class Rows:
        schema = T.StructType([])

        def __getattr__(self, name):
            return lambda *a, **k: a[0] if name == "mapInArrow" else self

    run = clusters._cluster_small(Rows(), ["hash"], ["id"], 300, 50)
    batch = pa.RecordBatch.from_pylist([{"id": n, "hash": f"c{n // 10}", "_x": [float(n % 10)], "_k": 2} for n in range(200)])
    parts = [p for at in range(0, 200, 45) for p in [batch.slice(at, 45)]]
    made = pa.Table.from_batches(list(run(iter(parts)))).sort_by("id")
    assert not calls and made.column("id").to_pylist() == list(range(200))
    one = made.column("_cluster").to_pylist()[:10]
    assert made.column("_cluster").to_pylist() == one * 20 and set(one) == {0, 1}


def changes(frame, rows):
    df = frame(rows, "hash int, project string, file string, class string, type string, contains_bug boolean, "
                     "author_date_unix_timestamp long, la double, ld double, wmc double, rfc double, totalFieldsQty double")
    return df.withColumn("author_date_unix_timestamp", F.timestamp_seconds("author_date_unix_timestamp"))


def some_changes(frame):
    return changes(frame, [
        (None if n % 17 == 3 else n, None if n % 13 == 5 else f"p{n % 2}", f"src/{'UserType' if n % 7 == 0 else 'A'}.java",
         None if n % 11 == 0 else f"C{n % 5}", "deleted" if n % 6 == 1 else "class", None if n % 4 == 0 else n % 3 == 0,
         None if n % 19 == 2 else 1_700_000_000 + n * 3600, float("nan") if n % 6 == 0 else float(n % 5),
         None if n % 6 == 4 else float(n % 2), float(n % 4), float(n % 3), float(n % 3))
        for n in [*range(90), *range(25), *range(7)]
    ])


@pytest.mark.parametrize("project", ["project", None])
def test_counts_equal_the_rules_one_by_one(frame, project):
    df = some_changes(frame)
    for rules in ((0, 2, 3, 5, 11, 1, 8), (2, 5, 8), (5, 1, 10, 2), (0, 0, 5, 2), (0,), (0, 5, 0, 2, 11), (3, 0, 2)):
        config = clean.CleanConfig(rules=rules, project=project, tie=("hash", "file"), gap_recent=40 * 3600, gap_deleted=9 * 3600)
        steps, table, want = clean._steps(config, df.columns), df, [(0, None, 122, None)]
        for at, number in enumerate(rules, 1):
            table = steps[number](table)
            n = table.count()
            want.append((at, number, n, want[-1][2] - n))
        for dealt in (False, True):
            got = clean.clean_counts(df, config=config, dealt=dealt).orderBy("step")
            assert [tuple(r) for r in got.collect()] == want
    assert got.dtypes == [("step", "int"), ("rule", "int"), ("rows", "bigint"), ("dropped", "bigint")]


def test_counts_read_the_rows_once(spark, frame):
    """The chain is not computed anew for every rule that compares rows: a pass to deal the rows, and one to count them."""
    df = some_changes(frame).coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    config = clean.CleanConfig(rules=(0, 2, 3, 5, 1, 8), project="project", tie=("hash", "file"), gap_recent=40 * 3600)
    clean.clean_counts(df.mapInArrow(watch, df.schema), config=config).collect()
    assert seen.value == 2 * 122


def test_changes_stay_where_their_order_is(spark, tmp_path, monkeypatch):
    """Dealt by its order, a table moves once: the view's groups, its join and equal changes need no other shuffle of wide rows."""
    from riftline.plans import bindings

    monkeypatch.setattr(bindings, "ROWS_PER_TASK", 50)
    spark.range(400).selectExpr(
        "if(id % 40 = 7, null, id % 90) AS l_orderkey", "id % 31 AS l_partkey", "cast(id % 5 AS int) AS l_linenumber",
        "cast(id % 9 AS double) AS l_quantity", "if(id % 3 = 0, 'A', 'N') AS l_returnflag", "if(id % 2 = 0, 'F', 'O') AS l_linestatus",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr(
        "id % 80 AS o_orderkey", "id % 6 AS o_custkey", "if(id % 4 = 0, 'F', 'P') AS o_orderstatus",
        "timestamp_seconds(1700000000 + id % 80 * 3600) AS o_orderdate", "concat('p', id % 2) AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    data = bindings.Data(spark, str(tmp_path))
    plain, dealt = data.view(bindings.CHANGES), data.view(bindings.CHANGES, lineitem="l_orderkey")
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))
    for limit in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            done = clean.rule_dedupe(dealt, copies="n")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert done.count("Exchange hashpartitioning(") == (2 if limit == "-1" else 1)


def test_rows_before_the_clusters_are_computed_once(spark, frame):
    df = commits(frame, {"small": (2.0, 1), "also": (3.0, 1), "big": (20.0, 9)}).withColumns(
        {"la": F.lit(1.0), "project": F.lit("p"), "class": F.lit("c")}
    )
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    config = clean.CleanConfig(rules=(5, 15), project="project", tie=("hash", "id"), features=["x", "y"], info=["id"])
    out = clean.clean_dataset(df.coalesce(1).mapInArrow(watch, df.schema), config=config)
    assert out.count() == 4 and seen.value == 11
