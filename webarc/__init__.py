"""A Spark engine for web-archive data."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it isn't installed on them but lies in a folder that they share with the driver, and gives them small batches."""
    env, here = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)
    return small_batches(spark)


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of 1 MB instead of Spark's 64, if the session hasn't said otherwise: each is held several times, in the JVM and in the worker, and texts can be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:  # with a default of None, get doesn't tell Spark's own
        spark.conf.set(key, "1m")
    return spark
