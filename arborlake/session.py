"""Sessions with the settings that the package's results assume."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(app: str = "arborlake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app).config(
        map={
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
        }
        | {k.replace("__", "."): v for k, v in conf.items()}
    )
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; clusters get it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)


def shared_scratch(spark: SparkSession) -> None:
    """Make checkpoints possible: the cluster's folder, or one of its own for a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='arborlake-')}"
        context.setCheckpointDir(folder)
