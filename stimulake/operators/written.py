"""Cuts in the lineage: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes ``df`` below ``spark.checkpoint.dir`` and reads it back, so that it is computed once and survives lost executors.

    Where that is unset and all runs in one process a temporary folder serves; on a cluster an unset folder is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stimulake-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/stimulake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
