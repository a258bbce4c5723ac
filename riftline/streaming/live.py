"""Streaming forms of the delayed-label evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riftline.functions.folds import col
from riftline.operators.models import predict_threshold
from riftline.operators.online import weights_score
from riftline.operators.vectors import features_array


def delayed_label_stream(
    predictions: DataFrame, labels: DataFrame, *, key: str, predicted_at: str, labelled_at: str,
    lateness: str = "1 hour", horizon: str = "30 days",
) -> DataFrame:
    """Join a stream of predictions to the labels that follow within ``horizon``.

    Both watermarks and the interval bound the state: a prediction is forgotten once its label can no
    longer come.
    """
    made = predictions.withWatermark(predicted_at, lateness).alias("p")
    known = labels.withWatermark(labelled_at, lateness).alias("l")
    when, then = F.col(f"p.{predicted_at}"), F.col(f"l.{labelled_at}")
    return made.join(
        known,
        (F.col(f"p.{key}") == F.col(f"l.{key}")) & (then >= when) & (then <= when + F.expr(f"interval {horizon}")),
    ).select("p.*", F.col(f"l.{labelled_at}"), F.col("l.label"))


class LiveLogistic:
    """A logistic model that a stream of labelled rows keeps up to date.

    Each micro-batch is scored with the weights from before it and then learned with one gradient step.
    The weights and scores of a batch are stored under its id, so a batch that is run again after a
    failure starts from the same weights and replaces its own output.
    """

    def __init__(self, folder: str, *, cols: Sequence[str], label: str, start: np.ndarray, rate: float = 0.05, l2: float = 0.0):
        self.folder, self.cols, self.label = folder, list(cols), label
        self.start, self.rate, self.l2 = np.asarray(start, dtype="float64"), rate, l2
        self.last: tuple[int, np.ndarray] | None = None  # the batch learned last and the weights after it

    def _before(self, spark, batch_id: int) -> np.ndarray:
        if batch_id == 0:
            return self.start
        if self.last and self.last[0] == batch_id - 1:
            return self.last[1]
        kept = spark.read.schema("weights array<double>").parquet(f"{self.folder}/weights/batch={batch_id - 1}")
        return np.array(kept.first().weights)

    def _learn(self, batch: DataFrame, batch_id: int) -> None:
        """One pass scores and writes the rows and sums their gradient on the way."""
        spark, missing = batch.sparkSession, F.lit(float("nan"))
        weights = self._before(spark, batch_id)
        rows = batch.withColumns({
            "_x": features_array(self.cols), "_y": col(self.label).cast("double"),
        })
        known = F.array(*[F.lit(float(w)) for w in weights])
        gap = F.coalesce(F.col("score"), missing) - F.col("_y")
        sums = [F.sum(gap * F.coalesce(F.col("_x")[n], missing)).alias(f"g{n}") for n in range(len(self.cols))]
        seen = Observation()
        scored = rows.withColumn("score", weights_score(rows, known)).observe(
            seen, *sums, F.sum(gap).alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_y").isNull()).alias("unlabelled")
        )
        predict_threshold(scored).drop("_x", "_y").write.mode("overwrite").parquet(f"{self.folder}/scored/batch={batch_id}")
        found = seen.get
        if found.get("unlabelled"):
            raise ValueError(f"batch {batch_id} has {found['unlabelled']} rows without a label")
        if found.get("n"):
            total = np.array([*[found[f"g{n}"] for n in range(len(self.cols))], found["g"]])
            weights = weights - self.rate * (total / found["n"] + np.r_[weights[:-1] * self.l2, 0.0])
        kept = spark.range(0, 1, 1, 1).select(F.array(*[F.lit(float(w)) for w in weights]).alias("weights"))
        kept.write.mode("overwrite").parquet(f"{self.folder}/weights/batch={batch_id}")
        self.last = (batch_id, weights)

    def run(self, stream: DataFrame, *, checkpoint: str) -> StreamingQuery:
        """Work through all rows that are there, batch by batch."""
        return (
            stream.writeStream.foreachBatch(self._learn).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def scored(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/scored")
