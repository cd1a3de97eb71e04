"""Written intermediate tables.

A table that several later steps read is written once to the shared checkpoint folder of the cluster. It survives the
loss of executors, and no step is computed again for every reader.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one for local sessions without the setting. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="factloom-")
    return _LOCAL[application]


def written(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet and read it back."""
    folder = checkpoint_folder(df.sparkSession)
    path = f"{folder.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
