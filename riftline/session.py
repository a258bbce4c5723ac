"""Session settings and the reliable checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import AtomicType

# Settings every job wants; the cluster's own values for memory and parallelism are left alone.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "riftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_code(spark)
    return spark


def ship_code(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_riftline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="riftline-code-")) / "riftline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves it to every executor
    context._riftline_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder: on a cluster that folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="riftline-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and pins row placement, and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once beside the checkpoints, in columns: a fraction of a checkpoint, for rows that several passes read.

    Columns of other than plain types, or whose names differ in case alone, are left to a checkpoint."""
    plain = all(isinstance(f.dataType, AtomicType) for f in df.schema)
    if not plain or len({c.lower() for c in df.columns}) < len(df.columns):
        return freeze(df)
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def at_once(spark: SparkSession, jobs: Iterable[Callable[[], Any]], number: int) -> list:
    """The results of ``jobs`` in order, ``number`` of them at a time; ``jobs`` itself is gone through in the caller's
    thread. Each thread has the caller's job settings."""
    with ThreadPoolExecutor(number) as pool:
        return list(pool.map(lambda job: job(), (inheritable_thread_target(spark)(job) for job in jobs)))
