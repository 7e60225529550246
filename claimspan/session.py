"""What a session needs before Python workers can run the library's functions."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: What Python workers get in their environment.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2"}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed: on one machine, or at the same path on all.

    On a cluster the package is installed or sent with --py-files; the added path then does no harm."""
    # Worker memory goes back to the machine: no growing threshold below which freed arrays stay, and no pool of Arrow's own.
    for name, value in WORKER.items():
        spark.sparkContext.environment.setdefault(name, value)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
