"""Trip and corpus analytics on Spark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. A cluster whose machines do not share
    that folder is given the package with --py-files."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])
