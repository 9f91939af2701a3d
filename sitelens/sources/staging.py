"""Written intermediate tables: they cut lineage, survive lost executors and keep column pruning."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables inside the cluster's checkpoint folder. A local session without
    one gets a temporary folder that goes with the process; on a cluster it is an error, as executors
    would write to their own disks and later reads would miss rows."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/sitelens-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def sql_conf(spark: SparkSession, key: str, value: str):
    """A session setting for the plans made inside the block."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
