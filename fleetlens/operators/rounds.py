"""Tables between the rounds of an iterative job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df as files in the shared folder that spark.checkpoint.dir names: lineage is cut, and a lost executor loses nothing.

    Where that is unset, a temporary folder if Spark runs in one process (tests); on a cluster an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="fleetlens-")
        context.setCheckpointDir(where)
    return df.checkpoint()
