"""Session settings that every entry point shares."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it is installed at the same path as on the driver.

    On a cluster that installs nothing, pass the package with ``--py-files`` instead; both can hold at once.
    """
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [root, *have] if x)


def local_session(cpus: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
