"""Cutting the lineage of tables that several plans read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names; a temporary one only on a local master where none is named."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="spark-cohortscore-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared scratch folder, so that it is computed once and outlives its executors."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()
