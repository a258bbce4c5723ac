"""Tables written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from riftline.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it back: the lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
