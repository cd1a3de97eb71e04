"""Files that tasks write by themselves, in the folder that all executors share.

A task writes to a name of its own and hands on one row about the file; only the rows of tasks that Spark has accepted reach the
manifest. What a lost or repeated task has left is never listed and so never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from factloom.operators.stages import checkpoint_folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a folder of its own in the shared folder; files and folders appear when tasks write."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def resolved(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a local path or of a URI (file, hdfs, s3, gs)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (arrow_fs.LocalFileSystem(), uri) if uri.startswith("/") else arrow_fs.FileSystem.from_uri(uri)


def task_file(folder: str, suffix: str) -> str:
    """A file name that no other task attempt uses; the folder is made if it is missing."""
    fs, path = resolved(folder)
    fs.create_dir(path, recursive=True)
    return f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"


def one_task_each(manifest: DataFrame, files: int, key: str) -> DataFrame:
    """The manifest with about one file for each task."""
    return manifest.repartitionByRange(max(1, files), key)


def free_name(wanted: str, taken: list[str]) -> str:
    """The name with as many underscores in front as keep it from clashing with others, whatever their case."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted
