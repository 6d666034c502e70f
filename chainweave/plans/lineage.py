"""Cutting the lineage of iterative plans in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of this process, which only a local master can use."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="chainweave-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """df, written and read again: what follows doesn't plan or compute again what came before, even if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/chainweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
