"""Where Python workers find this package when it is not installed."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> SparkSession:
    """Adds the package's folder to the workers' search path; where it does not exist, nothing changes."""
    found = spark.sparkContext.environment
    if ROOT not in found.get("PYTHONPATH", "").split(os.pathsep):
        found["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, found.get("PYTHONPATH")) if x)
    return spark
