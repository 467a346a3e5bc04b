"""A folder that driver and executors share, for files that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors see.

    Where it is unset and Spark runs in one process, as in tests, a temporary folder becomes it; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
