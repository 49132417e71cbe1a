"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from terrella.errors import StorageError

#: Used only where the session names no checkpoint folder and runs in one process, as in tests.
FALLBACK = "file:///tmp/terrella-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise StorageError("spark.checkpoint.dir must name a folder that the driver and all executors share.", code="no_shared_folder")
    root = root or FALLBACK
    return f"{root.rstrip('/')}/terrella/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder, read back: computed once, and any executor may go."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
