"""Cutting lineage between the steps of a run."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir, so that what follows neither plans nor computes it again.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="chorale-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
