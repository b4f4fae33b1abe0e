"""The folder all executors can reach, for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a temporary
    folder. A cluster without it is refused: its executors share no local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="lakewarden-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
