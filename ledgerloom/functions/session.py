"""The session's shared folder."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the cluster's spark.checkpoint.dir. Only a session whose executors run
    in the driver's own process (master local) gets a folder of its own where that is unset; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def one_row(*rows: DataFrame) -> DataFrame:
    """The columns of several one-row tables side by side."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))
