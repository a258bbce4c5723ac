import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.operators.clean import CleanConfig
from riftline.plans import training
from riftline.functions.folds import normal, uniform
from riftline.operators import evaluate, explain, models, resample, select
from riftline.operators import neighbours
from riftline.operators.neighbours import knn_join

COLS = ["noise", "signal", "copy", "flat"]


@pytest.fixture(scope="module")
def planted(spark):
    """``signal`` is the label with a little noise, ``copy`` nearly repeats it."""
    y = (F.col("id") % 4 == 0).cast("int")
    return spark.range(400).select(
        "id", y.alias("y"), normal(F.col("id"), F.lit(1)).alias("noise"),
        (y + 0.2 * normal(F.col("id"), F.lit(2))).alias("signal"), F.lit(2.0).alias("flat"),
    ).withColumn("copy", F.col("signal") + 0.1 * normal(F.col("id"), F.lit(3))).persist()


def first(df):
    return df.orderBy("rank").first().feature


def test_draws_are_spread(spark):
    row = spark.range(20000).agg(
        F.avg(uniform("id")), F.avg(normal(F.col("id"))), F.stddev_pop(normal(F.col("id")))
    ).first()
    assert row[:] == pytest.approx((0.5, 0, 1), abs=0.03)


def test_planted_signal_wins(planted):
    given = {"cols": COLS, "label": "y"}
    assert first(select.label_correlation(planted, **given)) == "signal"
    assert first(select.anova_f(planted, **given)) == "signal"
    assert first(select.tree_importance(planted, trees=10, **given)) in ("signal", "copy")
    assert first(select.select_model_threshold(planted, maxIter=3, **given)) in ("signal", "copy")
    assert first(select.select_l1(planted, **given)) in ("signal", "copy")
    assert select.select_rfe(planted, k=2, **given).count() == 2
    chosen = [r.feature for r in select.select_mrmr(planted, k=3, **given).orderBy("rank").collect()]
    assert chosen[0] == "signal" and "flat" not in chosen
    scores = {r.feature: r.score for r in select.anova_f(planted, top=None, **given).collect()}
    assert scores["flat"] is None


def test_correlation_against_numpy(planted):
    rows = planted.select(*COLS).toPandas()
    want = np.corrcoef(rows[COLS[:3]].to_numpy().T)
    got = {(r.a, r.b): r.r for r in select.correlation_matrix(planted, cols=COLS).collect()}
    for i in range(3):
        for j in range(i + 1, 3):
            assert got[(COLS[i], COLS[j])] == pytest.approx(want[i, j])
    assert got[("noise", "flat")] is None
    assert [r.feature for r in select.select_cbfs(planted, cols=COLS).orderBy("position").collect()] == ["noise", "signal", "flat"]
    assert select.select_features(planted, cols=COLS, label="y", method="CBFS") == ["noise", "signal", "flat"]
    with pytest.raises(ValueError):
        select.select_features(planted, cols=COLS, label="y", method="other")


def test_constant_and_negative_columns(planted, frame):
    assert select.drop_constant(planted, cols=COLS) == COLS[:3]
    with pytest.raises(ValueError):
        select.drop_constant(planted, cols=["flat"])
    with pytest.raises(ValueError):
        select.chi2_score(planted, cols=["noise"], label="y")
    counts = frame([(0, 1.0), (0, 3.0), (1, 8.0), (1, 0.0)], "y int, x double")
    assert select.chi2_score(counts, cols=["x"], label="y").first().score == pytest.approx(2 * 4 / 6)


def test_pca_centres(planted):
    train, test = select.pca_project(planted, planted.limit(10), cols=COLS[:3], k=2)
    means = train.agg(F.avg(F.col("pc")[0]), F.avg(F.col("pc")[1])).first()
    assert means[:] == pytest.approx((0, 0), abs=1e-9) and test.count() == 10


# ------------------------------------------------------------ neighbours

def brute(left, right, k, same):
    out = {}
    for i, v in left.items():
        gaps = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in right.items() if not (same and i == j))
        out[i] = [(j, round(g, 9)) for g, j in gaps[:k]]
    return out


@pytest.mark.parametrize("same,pivots,block,shape", [
    (True, 1, 1000, "ball"), (True, 9, 13, "ball"), (True, 7, 10, "hot"), (False, 5, 17, "ball"), (True, 4, 50, "clumps"),
])
def test_knn_is_exact(frame, same, pivots, block, shape):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(160, 3))
    if shape == "hot":
        points[:60] = points[0]  # a third of the rows are copies
    if shape == "clumps":
        points += np.repeat(np.arange(4) * 50, 40)[:, None]
    rows = {n: p for n, p in enumerate(points)}
    right = rows if same else {n: p for n, p in list(rows.items())[80:]}
    left = rows if same else {n: p for n, p in list(rows.items())[:80]}

    def table(of):
        return frame([(n, [float(x) for x in p]) for n, p in of.items()], "id long, features array<double>").repartition(3)

    found = knn_join(table(left), table(right), k=4, exclude_self=same, pivots=pivots, block=block)
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, round(r.distance, 9)))
    assert got == brute(left, right, 4, same)


def test_small_cells_share_a_block(frame):
    sizes, anchors = np.array([3, 4, 9, 2, 30]), np.array([[0.0], [10.0], [1.0], [11.0], [50.0]])
    group = neighbours._grouped(sizes, anchors, 12)
    assert group[0] == group[2] and group[1] == group[3] and len(set(group)) == 3
    rows = np.random.default_rng(8).normal(size=(200, 2)) + np.repeat(np.arange(10) * 9, 20)[:, None]
    table = frame([(n, [float(x) for x in p]) for n, p in enumerate(rows)], "id long, features array<double>").repartition(3)
    got = {}
    for r in neighbours.knn_join(table, table, k=4, exclude_self=True, pivots=16, block=60).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, round(r.distance, 9)))
    assert got == brute(dict(enumerate(rows)), dict(enumerate(rows)), 4, True)


def test_limits_keep_enough():
    rough = np.random.default_rng(2).normal(size=(50, 1000))
    limit = neighbours._limits(rough, 6)
    assert ((rough <= limit[:, None]).sum(axis=1) >= 6).all()


def test_fewer_rows_than_k(frame):
    df = frame([(1, [0.0]), (2, [1.0])], "id long, features array<double>")
    assert knn_join(df, df, k=5, exclude_self=True).count() == 2


def test_smote_and_adasyn(planted):
    given = {"key": "id", "cols": COLS[:3], "label": "y"}
    made = resample.smote(planted, **given)
    assert {r.y: r["count"] for r in made.groupBy("y").count().collect()} == {0: 300, 1: 300}
    assert made.select("id").distinct().count() == 600
    old = planted.filter("y = 1").agg(F.min("signal"), F.max("signal")).first()
    new = made.filter("id < 0").agg(F.min("signal"), F.max("signal")).first()
    assert old[0] <= new[0] and new[1] <= old[1]
    again = resample.smote(planted.repartition(5), **given)
    assert made.exceptAll(again).count() == 0
    dense = resample.adasyn(planted, **given)
    assert dense.filter("id < 0").count() > 0 and dense.select("id").distinct().count() == dense.count()
    with pytest.raises(ValueError):
        resample.smote(planted.filter("y = 0 OR id = 4"), **given)


def test_cleaning_of_borders(frame):
    # 1 and 2 are mutual nearest rows of different classes; 0 is the rarer class here.
    rows = [(1, 0.0, 1), (2, 0.1, 0), (3, 5.0, 1), (4, 5.1, 1), (5, 5.2, 1), (6, 9.0, 0), (7, 5.3, 1), (8, 9.1, 0)]
    df = frame(rows, "id long, x double, y int")
    kept = resample.tomek_links(df, key="id", cols=["x"], label="y")
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4, 5, 6, 7, 8]
    kept = resample.edited_nn(df, key="id", cols=["x"], label="y")
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4, 5, 6, 7, 8]
    cut = resample.undersample(df, key="id", label="y")
    assert {r.y: r["count"] for r in cut.groupBy("y").count().collect()} == {0: 3, 1: 3}


# ------------------------------------------------------------ models and scores

def test_models_learn(planted):
    given = {"cols": COLS[:3], "label": "y"}
    fits = [
        models.fit_logistic(planted, **given),
        models.fit_random_forest(planted, numTrees=5, **given),
        models.fit_boosted_trees(planted, n_estimators=3, pos_weight=2.0, reg_alpha=0.1, **given),
        models.fit_mlp(planted, hidden=(4,), maxIter=30, **given),
        models.fit_balanced_forest(planted, key="id", trees=3, **given),
    ]
    for model in fits:
        scored = model.score(planted)
        assert scored.columns == [*planted.columns, "score", "prediction"]
        assert evaluate.roc_auc(scored, label="y").first()[0] > 0.95


def test_tune(planted):
    given = {"cols": COLS[:3], "label": "y", "key": "id", "folds": 2, "trials": 2}
    space = {"maxDepth": models._whole(2, 3), "numTrees": models._whole(2, 4)}
    forest = models.tune_cv(planted, model="random_forest", space=space, **given)
    assert set(forest.params) == set(space) and 0.8 < forest.score <= 1
    balanced = models.tune_cv(planted, model="balanced_forest", space=space, **given)
    assert len(balanced.trials) == 2 and balanced.score > 0.8
    with pytest.raises(ValueError):
        models.tune_cv(planted, model="other", space=space, **given)
    assert models.draw_params("boosted_trees", 2) == models.draw_params("boosted_trees", 2)


def test_scores(frame):
    df = frame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (0, 0.5)], "label int, score double")
    assert evaluate.average_precision(df).first()[0] == pytest.approx(5 / 6)
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(5 / 6)
    tied = frame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert evaluate.roc_auc(tied).first()[0] == 0.5 and evaluate.average_precision(tied).first()[0] == 0.5
    assert evaluate.average_precision(df.filter("label = 1")).first()[0] == 0.0


def test_report(frame):
    df = frame([(1, 0), (0, 0), (0, 0), (1, 0)], "label int, prediction int")
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert report["1"].precision == 0 and report["0"].precision == 0.5 and report["accuracy"].f1 == 0.5
    assert report["weighted avg"].recall == 0.5 and report["macro avg"].support == 4
    assert [r.n for r in evaluate.confusion_matrix(df).collect()] == [2, 0, 2, 0]


# ------------------------------------------------------------ explanations

def test_explanations(planted):
    cols = ["noise", "signal"]
    model = models.fit_logistic(planted, cols=cols, label="y")
    shuffled = {r.feature: r.importance for r in explain.permutation_importance(model, planted, cols=cols, label="y", key="id", repeats=3).collect()}
    assert shuffled["signal"] > 0.1 > abs(shuffled["noise"])
    curve = explain.partial_dependence(model, planted, cols=cols, grid=5).filter("feature = 'signal'").orderBy("value").collect()
    assert len(curve) == 5 and curve[0].mean_score < 0.5 < curve[-1].mean_score
    near = explain.local_surrogate(model, planted.limit(5), cols=cols, key="id", train=planted, samples=200)
    assert near.count() == 10
    assert near.filter("rank = 1 AND feature = 'signal' AND weight > 0").count() >= 3
    background = [0.0, 0.0]
    values = explain.shapley_values(model, planted, cols=cols, key="id", background=background, permutations=4)
    total = values.groupBy("id").agg(F.sum("value").alias("v"))
    base = model.score(planted.select(F.lit(0.0).alias("noise"), F.lit(0.0).alias("signal")).limit(1)).first().score
    gap = model.score(planted).join(total, "id").filter(F.abs(F.col("score") - base - F.col("v")) > 1e-9)
    assert gap.count() == 0
    bars = {r.feature: r.mean_abs for r in explain.mean_abs_attribution(values).collect()}
    assert bars["signal"] > bars["noise"]


def test_made_keys_avoid_given_ones(frame):
    rows = [(-n, float(n), 1 if n > 8 else 0) for n in range(1, 13)]
    made = resample.smote(frame(rows, "id long, x double, y int"), key="id", cols=["x"], label="y", k=2)
    assert made.count() == 16 and made.select("id").distinct().count() == 16
    with pytest.raises(TypeError):
        resample.smote(frame([(str(k), x, y) for k, x, y in rows], "id string, x double, y int"), key="id", cols=["x"], label="y", k=2)


def test_run_fills_and_keeps_the_test_period(frame):
    rows = [
        (n, 1_600_000_000 + n, "p", None if n % 4 == 0 else float(n % 5), None if n == 7 else n % 2 == 0, float(n % 3), 1.0)
        for n in range(40)
    ]
    df = frame(rows, "id long, t long, project string, la double, contains_bug boolean, totalMethodsQty double, totalFieldsQty double")
    df = df.withColumn("t", F.timestamp_seconds("t"))
    config = training.RunConfig(
        features=["la"], time="t", clean=CleanConfig(rules=(0, 3), time="t", tie=("id",), project="project"), clean_after_split=True
    )
    sides = training._cleaned_sides(df, config)
    assert {r.id for r in sides.filter("is_test").collect()} <= set(range(32, 40))
    assert {r.id for r in sides.filter("NOT is_test").collect()} <= set(range(32))
    filled = training._filled(sides, ["la"])
    assert filled.filter("la IS NULL").count() == 0 and filled.count() == sides.count()


def test_run_outputs(spark, frame, tmp_path):
    schema = "dataset string, split string, class string, precision double, recall double, f1 double, support long"
    report = frame([("p", "date", "1", 0.5, 0.5, 0.5, 3), ("p", "online", "1", 0.25, 0.5, 0.4, 2)], schema)
    params = frame([("p", "date", "maxDepth", "3")], "dataset string, split string, param string, value string")
    counts = spark.createDataFrame([("p", 8, 2, 1, 0, 0)], training.COUNTS)
    training.write_run(training.RunResult(report, params, {}, counts), str(tmp_path / "run"))
    row = spark.read.option("header", "true").csv(str(tmp_path / "run/report")).first()
    assert (row.date_precision, row.online_precision) == ("0.5", "0.25")
    assert spark.read.json(str(tmp_path / "run/params")).first().param == "maxDepth"


def test_local_surrogate_of_repeated_and_missing_keys(frame):
    """All samples of a key are fitted together, also where several rows or no row name it."""
    rng = np.random.default_rng(4)
    train = frame([(n, float(x), float(z), int(x > 0)) for n, (x, z) in enumerate(rng.normal(size=(200, 2)))], "id int, x double, z double, y int")
    model = models.fit_boosted_trees(train, cols=["x", "z"], label="y", n_estimators=2, max_depth=2)
    rows = frame([(1, 0.5, 0.1), (1, -0.5, 0.3), (None, 0.2, 0.2), (2, None, 0.4)], "id int, x double, z double")
    found = explain.local_surrogate(model, rows, cols=["x", "z"], key="id", train=train, samples=50)
    # No sample is shuffled: the exchange carries one table of sums per key.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.weight)
    assert sorted(got, key=str) == [1, 2, None] and all(len(v) == 2 and abs(v[0]) >= abs(v[1]) for v in got.values())
    noise = F.array(*[F.when(F.col("s") == 0, 0.0).otherwise(normal(F.col("id"), F.col("s"), F.lit(n), F.lit(42))) for n in range(2)])
    spread = train.agg(F.stddev_pop("x"), F.stddev_pop("z")).first()
    samples = rows.select("id", "x", "z", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("s")).withColumn("n", noise)
    moved = samples.select("id", "n", (F.col("x") + F.col("n")[0] * spread[0]).alias("x"), (F.col("z") + F.col("n")[1] * spread[1]).alias("z"))
    mine = [r for r in model.score(moved).collect() if r.id == 1]
    z = np.array([r.n for r in mine])
    w = np.exp(-(z**2).sum(axis=1) / (0.75**2 * 2))
    x = np.c_[z, np.ones(len(z))]
    beta = np.linalg.solve((x * w[:, None]).T @ x + np.diag([1.0, 1.0, 0.0]), (x * w[:, None]).T @ np.array([r.score for r in mine]))[:2]
    assert got[1] == pytest.approx(sorted(beta, key=lambda v: -abs(v)))
