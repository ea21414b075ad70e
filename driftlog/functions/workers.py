"""Python workers must find this package where the driver does, whatever folder the driver runs in."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path. On a cluster whose machines do not share it,
    ship the package as usual (--py-files or an image); this then does no harm."""
    own = spark.sparkContext.environment
    paths = [p for p in own.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        own["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
