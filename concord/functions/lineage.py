"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder that spark.checkpoint.dir names; set here only where it is unset and all runs on this machine, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="concord-"))
    return df.checkpoint()
