"""Cut the lineage of iterative plans reliably."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names; a local one where none is set and the master is local, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            where = "file://" + tempfile.mkdtemp(prefix="peregrin-")
        sc.setCheckpointDir(where)
    return df.checkpoint()
