"""Where databases without a given root go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under ``spark.checkpoint.dir`` where
    that is set, else (one machine) a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='tsqlspark-')).rstrip('/')}/db-{uuid.uuid4().hex}"
