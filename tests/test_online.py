import threading
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.functions.folds import normal
from riftline.operators import models, online
from riftline.session import at_once
from riftline.streaming.live import LiveLogistic, delayed_label_stream


def learned(spark, i, **options):
    return spark.range(i, i + 1).select(online.learned_before(F.col("id"), **options)).first()[0]


@pytest.mark.parametrize("mode,delay,frequency,pairs", [
    ("batched", 150, 50, {0: 0, 199: 0, 200: 50, 249: 50, 250: 100}),
    ("each", 2, 1, {1: 0, 2: 1, 3: 2}),
    ("after_predict", 2, 1, {2: 0, 3: 1}),
])
def test_schedule(spark, mode, delay, frequency, pairs):
    for i, want in pairs.items():
        assert learned(spark, i, delay=delay, frequency=frequency, mode=mode) == want
    n = 260
    every = spark.range(n).select(online.learned_before(F.col("id"), delay=delay, frequency=frequency, mode=mode).alias("l"))
    cuts = sorted({r.l for r in every.collect()})
    assert cuts == online.cuts_of(n, delay=delay, frequency=frequency, mode=mode)


def test_schedule_refuses(spark):
    with pytest.raises(ValueError):
        learned(spark, 1, delay=1, frequency=0)
    with pytest.raises(ValueError):
        learned(spark, 1, delay=1, mode="other")


@pytest.fixture(scope="module")
def timeline(spark):
    y = (F.xxhash64("id") % 2 == 0).cast("int")
    return spark.range(160).select(
        "id", y.alias("y"), (y + 0.5 * normal(F.col("id"), F.lit(1))).alias("a"), normal(F.col("id"), F.lit(2)).alias("b")
    ).persist()


GIVEN = {"order": ["id"], "cols": ["a", "b"], "label": "y", "delay": 10}


def test_bayes_equals_refits(timeline):
    """The one-pass refits give what a separate fit per row gives."""
    train, test = timeline.filter("id < 100"), timeline.filter("id >= 100")
    for mode, frequency in (("each", 1), ("batched", 15), ("after_predict", 1)):
        got = online.online_retrain_bayes(train, test, mode=mode, frequency=frequency, **GIVEN).orderBy("i").collect()
        rows = timeline.orderBy("id").toPandas()
        floor = 1e-9 * max(rows[:100].a.var(ddof=0), rows[:100].b.var(ddof=0))
        assert len(got) == 60
        for r in got[::7]:
            known = rows[: 100 + r.learned]
            log = []
            for part in (0, 1):
                mine = known[known.y == part]
                value = np.log(len(mine) / len(known))
                for c in ("a", "b"):
                    var = mine[c].var(ddof=0) + floor
                    value += -0.5 * (np.log(2 * np.pi * var) + (rows[c][100 + r.i] - mine[c].mean()) ** 2 / var)
                log.append(value)
            assert r.score == pytest.approx(1 / (1 + np.exp(log[0] - log[1])), abs=1e-9)


def test_retrain_by_fits(timeline):
    train, test = timeline.filter("id < 100"), timeline.filter("id >= 100")
    seen = []

    def fit(rows):
        seen.append(rows.count())
        return models.fit_logistic(rows, cols=["a", "b"], label="y", maxIter=5)

    out = online.online_retrain_batched(train, test, fit=fit, frequency=20, **GIVEN)
    assert out.count() == 60 and seen == [100, 120, 140]
    assert [r[0] for r in out.groupBy("learned").count().orderBy("learned").collect()] == [0, 20, 40]


def test_refits_of_few_rows_are_one_task_each(timeline):
    train, test = timeline.filter("id < 100").repartition(7), timeline.filter("id >= 100")
    parts = []

    def fit(rows):
        parts.append(rows.rdd.getNumPartitions())
        return models.fit_logistic(rows, cols=["a", "b"], label="y", maxIter=5)

    out = online.online_retrain_batched(train, test, fit=fit, frequency=20, **GIVEN)
    assert sorted(r.i for r in out.collect()) == list(range(60)) and parts == [1, 1, 1]


@pytest.mark.parametrize("settings", [{"regParam": 0.01, "maxIter": 20}, {"maxIter": 3}, {"regParam": 0.1, "tol": 1e-9}])
def test_logistic_refits_together(spark, timeline, settings):
    """All refits of a logistic regression give the scores of separate fits, in jobs that do not grow with the refits."""
    rows = timeline.select("*", F.lit(0.1).alias("flat"), (F.col("b") * 1000 + 5).alias("wide"))
    train, test = rows.filter("id < 100").repartition(3), rows.filter("id >= 100")
    cols = ["a", "flat", "b", "wide"] if "regParam" in settings else ["a", "b"]
    given = {**GIVEN, "cols": cols, "frequency": 1}
    fit = partial(models.fit_logistic, cols=cols, label="y", **settings)
    spark.sparkContext.setJobGroup("together", "refits")
    got = online.online_retrain_batched(train, test, fit=fit, **given).orderBy("i").collect()
    spark.sparkContext.setJobGroup("after", "others")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("together")) < 150
    assert [r.i for r in got] == list(range(60)) and len({r.learned for r in got}) == 50
    for r in got[::19]:
        known = train.unionByName(test.filter(F.col("id") < 100 + r.learned))
        alone = fit(known.coalesce(1)).score(test.filter(F.col("id") == 100 + r.i)).first()
        assert (r.label, r.prediction) == (alone.y, alone.prediction) and r.score == pytest.approx(alone.score, abs=1e-10)


def test_logistic_refits_of_one_class(timeline):
    """A model that has seen one class only predicts that class, as a separate fit does."""
    train, test = timeline.filter("id < 100 AND y = 1"), timeline.filter("id >= 100")
    fit = partial(models.fit_logistic, cols=["a", "b"], label="y", regParam=0.01)
    got = online.online_retrain_batched(train, test, fit=fit, frequency=20, **GIVEN).collect()
    assert {r.learned for r in got} == {0, 20, 40} and {r.score for r in got if not r.learned} == {1.0}
    one = next(r for r in got if r.learned == 40)
    alone = fit(train.unionByName(test.filter("id < 140"))).score(test.filter(F.col("id") == 100 + one.i)).first()
    assert one.score == pytest.approx(alone.score, abs=1e-10)


def test_jobs_at_once(spark):
    """Two jobs that wait for each other end, and results keep their order."""
    meet = threading.Barrier(2, timeout=60)

    def job(n):
        meet.wait()
        return spark.range(n).count()

    assert at_once(spark, (partial(job, n) for n in (3, 5)), 2) == [3, 5]


def by_hand(rows, weights, batches, rate):
    states = []
    for part in batches:
        states.append(weights)
        x = np.c_[rows[["a", "b"]].to_numpy()[part], np.ones(len(part))]
        p = 1 / (1 + np.exp(-x @ weights))
        weights = weights - rate * x.T @ (p - rows.y.to_numpy()[part]) / len(part)
    return [*states, weights]


def test_incremental_steps(timeline):
    train, test = timeline.filter("id < 100"), timeline.filter("id >= 100")
    got = online.online_incremental_batched(train, test, frequency=20, rate=0.1, **GIVEN).orderBy("i").collect()
    start = online.initial_weights(train, cols=["a", "b"], label="y")
    rows = test.orderBy("id").toPandas()
    states = by_hand(rows, start, [range(0, 20), range(20, 40)], 0.1)
    for r in got:
        w = states[r.learned // 20]
        x = rows.loc[r.i, ["a", "b"]].to_numpy(dtype=float)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(x @ w[:2] + w[2]))))
    single = online.online_incremental(train, test.limit(14), rate=0.1, **GIVEN)
    assert sorted(r.learned for r in single.collect()) == [0] * 10 + [1, 2, 3, 4]


def test_prequential(timeline):
    out = online.prequential_logistic(timeline, order=["id"], cols=["a", "b"], label="y", k=3, batch=20, rate=0.5)
    scores = [r.score for r in out.orderBy("fold").collect()]
    assert len(scores) == 3 and min(scores) > 0.7
    best, score = online.tune_prequential(timeline, trials=2, order=["id"], cols=["a", "b"], label="y", k=2, batch=40)
    assert set(best) == {"rate", "l2"} and score > 0.5
    with pytest.raises(ValueError):
        online.prequential_logistic(timeline, order=["id"], cols=["a"], label="y", k=20)


def test_delayed_labels(frame):
    df = frame([(n, n % 2, n % 3 % 2) for n in range(6)], "t int, prediction int, label int")
    out = online.delayed_label_join(df, order=["t"], delay=4).orderBy("i").collect()
    assert [(r.i, r.made_at, r.prediction, r.label, r.correct) for r in out] == [(4, 0, 0, 0, True), (5, 1, 1, 1, True)]


@pytest.mark.parametrize("parts", [1, 3])
def test_live_model(spark, timeline, tmp_path, parts):
    """Each micro-batch is scored before it is learned, and a batch run again changes nothing."""
    source = str(tmp_path / "in")
    for n in range(parts):
        timeline.filter(F.col("id") % parts == n).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    live = LiveLogistic(str(tmp_path / "live"), cols=["a", "b"], label="y", start=np.zeros(3), rate=0.5)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.run(stream, checkpoint=str(tmp_path / "cp")).awaitTermination()
    out = live.scored(spark)
    assert out.count() == 160 and out.select("batch").distinct().count() == parts
    assert {r.score for r in out.filter("batch = 0").select("score").distinct().collect()} == {0.5}
    before = spark.read.parquet(str(tmp_path / "live/weights/batch=0")).first()
    first = [r.id for r in out.filter("batch = 0").collect()]
    live._learn(timeline.filter(F.col("id").isin(first)), 0)
    assert np.allclose(spark.read.parquet(str(tmp_path / "live/weights/batch=0")).first().weights, before.weights)


def test_label_stream(spark, frame, tmp_path):
    rows = [(n, 1_700_000_000 + n * 60, n % 2) for n in range(20)]
    base = frame(rows, "k long, s long, label int")
    base.select("k", F.timestamp_seconds("s").alias("at")).write.parquet(str(tmp_path / "p"))
    late = F.when(F.col("k") == 3, 40 * 86400).otherwise(3600)
    base.select("k", F.timestamp_seconds(F.col("s") + late).alias("then"), "label").write.parquet(str(tmp_path / "l"))

    def stream(name):
        path = str(tmp_path / name)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    joined = delayed_label_stream(stream("p"), stream("l"), key="k", predicted_at="at", labelled_at="then")
    joined.writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [n for n in range(20) if n != 3]


@pytest.mark.parametrize("chunk", [50, 8, 1000])
def test_steps_in_chunks(timeline, monkeypatch, chunk):
    """Several chunks, steps larger than a chunk, and one chunk give the weights of the steps done by hand."""
    monkeypatch.setattr(online, "CHUNK_ROWS", chunk)
    train, test = timeline.filter("id < 40"), timeline.filter("id >= 40")
    got = online.online_incremental_batched(train, test, frequency=20, rate=0.1, l2=0.0, **GIVEN).orderBy("i").collect()
    rows = test.orderBy("id").toPandas()
    states = by_hand(rows, online.initial_weights(train, cols=["a", "b"], label="y"), [range(n, n + 20) for n in range(0, 100, 20)], 0.1)
    assert len(got) == 120 and {r.learned for r in got} == {0, 20, 40, 60, 80, 100}
    for r in got:
        w, x = states[r.learned // 20], rows.loc[r.i, ["a", "b"]].to_numpy(dtype=float)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(x @ w[:2] + w[2]))))


def jobs_of(spark, work):
    name = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_steps(spark, timeline):
    def run(batch):
        return lambda: online.prequential_logistic(timeline, order=["id"], cols=["a", "b"], label="y", k=3, batch=batch)

    assert jobs_of(spark, run(1)) < jobs_of(spark, run(40)) + 20  # 160 steps against 4


def test_live_batch_is_one_pass(spark, timeline, tmp_path):
    live = LiveLogistic(str(tmp_path), cols=["a", "b"], label="y", start=np.zeros(3), rate=0.5, l2=0.1)
    live._learn(timeline, 0)
    assert jobs_of(spark, lambda: live._learn(timeline, 1)) == 2  # the scored rows and the weights
    rows = timeline.orderBy("id").toPandas()
    w = by_hand(rows, np.zeros(3), [range(160)], 0.5)[-1]
    got = spark.read.parquet(f"{tmp_path}/weights/batch=0").first().weights
    assert np.allclose(got, w)
    x = np.c_[rows[["a", "b"]].to_numpy(), np.ones(160)]
    w = w - 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - rows.y.to_numpy()) / 160 + 0.1 * np.r_[w[:2], 0])
    assert np.allclose(spark.read.parquet(f"{tmp_path}/weights/batch=1").first().weights, w)
    with pytest.raises(ValueError):
        live._learn(timeline.withColumn("y", F.lit(None).cast("int")), 2)
