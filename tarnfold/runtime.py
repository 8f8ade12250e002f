"""What Python workers need."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Let workers on machines that hold this package import it, wherever the driver was started. Elsewhere it has to be sent with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the folder that all executors share, as spark.checkpoint.dir names it.

    Only a local session without that setting gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tarnfold-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
