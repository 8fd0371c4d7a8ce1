"""The folder that driver and executors share."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a default, but only if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or "/tmp/checkpoints/wayline").rstrip("/")
